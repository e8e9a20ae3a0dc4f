"""Language identification by segmentation-marginalised unigrams (operator 6).

A language is a unigram distribution over the pieces of a fixed public
vocabulary. A text's probability under a language is the sum over *all*
segmentations of its words into pieces of the product of the piece
probabilities; a forward pass over the characters computes that sum. White
space only separates words (each word starts with the vocabulary's word mark),
so the sum over a text factorises into one forward pass per distinct word.

Learning: piece counts of the labelled texts, aggregated by Spark over all
rows; at most (pieces x languages) rows reach the driver. The probabilities
are interpolated with the all-language distribution, so none is zero.
A character outside the vocabulary costs the product of its UTF-8 byte pieces.

Defined results: null text, or text without a letter: ``und`` with score 0; a
model without any language (empty training table) says ``und`` for every row;
rows with a null language are not learnt from; repeated rows are scored alike;
ties go to the first language in sorted order; other columns pass through, and
an input column named like an output column is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, extended_schema, map_arrow, read_table, sub_batches, texts, with_columns, worker_stores

VOCAB = "piece_bpe_32k.model"
MARK = "▁"
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
MIX = 0.05            # weight of the all-language distribution
BATCH_BYTES = 2 << 20  # of text learnt from or scored at a time
FLUSH_WORDS = 100_000  # distinct words held before they are segmented
MODEL_BYTES = 1 << 28  # largest model that is broadcast
RESCALE = 16
ROWS, ROW_LETTERS = 8_192, 1 << 20    # words, and characters of words, summed at a time
STORE_WORDS, STORE_CHARS = 200_000, 64    # words that a worker keeps, and their most characters
TINY = 1e-200         # forward value below which a word is summed in log space

_pieces: dict[str, tuple] = {}


def _processor(path: str):
    """(processor, piece -> id, longest piece, id of each byte piece), once per worker."""
    if path not in _pieces:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, byte_ids = {}, np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                ids[sp.id_to_piece(i)] = i
        _pieces[path] = (sp, ids, max(map(len, ids)), byte_ids)
    return _pieces[path]


@dataclass
class LanguageModel:
    """langs, log priors, and P[piece, language] with one zero row appended."""

    langs: list[str]
    prior: np.ndarray
    prob: np.ndarray
    vocab: str
    key: str = field(default_factory=lambda: uuid.uuid4().hex)   # names the model to the stores of workers


def _piece_counts(vocab: str, text_col: str, lang_col: str):
    def run(batches):
        sp = _processor(vocab)[0]
        words: dict[str, Counter] = {}
        n_docs: Counter = Counter()
        counts: dict[str, np.ndarray] = {}

        def flush():
            for lang, c in words.items():
                own = counts.setdefault(lang, np.zeros(sp.get_piece_size()))
                held = list(c)
                for a in range(0, len(held), ROWS):
                    part = held[a:a + ROWS]
                    ids = sp.encode(part, num_threads=1)
                    n = np.fromiter(map(c.__getitem__, part), np.int64, len(part))
                    flat = np.concatenate([np.asarray(x, np.int64) for x in ids])
                    own += np.bincount(flat, np.repeat(n, [len(x) for x in ids]), len(own))
            words.clear()

        for whole in batches:
            for batch in sub_batches(whole, text_col, BATCH_BYTES):
                for lang, text in zip(texts(batch, lang_col), texts(batch, text_col), strict=True):
                    n_docs[lang] += 1
                    words.setdefault(lang, Counter()).update((text or "").split())
                    if sum(map(len, words.values())) > FLUSH_WORDS:
                        flush()
        flush()
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(at) + 1), pa.string()),
                "piece": pa.array(np.append(at, -1).astype(np.int32)),
                "n": pa.array(np.append(own[at].astype(np.int64), n_docs[lang]))})
    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
        vocab: str | None = None) -> LanguageModel:
    """Learn from every row of ``labelled`` whose language is not null."""
    vocab = vocab or public_tokenizers.path(VOCAB)
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    per = (map_arrow(rows, _piece_counts(vocab, text_col, lang_col), "lang string, piece int, n long")
           .groupBy("lang", "piece").agg(F.sum("n").alias("n")))
    got = per.toArrow()
    lang, piece, n = (got.column(c).to_numpy() for c in ("lang", "piece", "n"))
    langs = sorted(set(lang))
    size = _processor(vocab)[0].get_piece_size()
    if 8 * (size + 1) * len(langs) > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages make a model larger than {MODEL_BYTES} bytes")
    at = {x: i for i, x in enumerate(langs)}
    col = np.array([at[x] for x in lang], np.int64)
    counts, docs = np.zeros((size, len(langs))), np.zeros(len(langs))
    is_doc = piece < 0
    docs[col[is_doc]] = n[is_doc]
    counts[piece[~is_doc], col[~is_doc]] = n[~is_doc]
    every = counts.sum(1) + 0.5
    every /= every.sum()
    total = counts.sum(0)
    own = np.where(total > 0, counts / np.maximum(total, 1), every[:, None])
    prob = np.vstack([(1 - MIX) * own + MIX * every[:, None], np.zeros((1, len(langs)))])
    prior = np.log(docs / docs.sum()) if len(langs) else docs
    return LanguageModel(langs, prior, prob, vocab)


def _log_forward(word: str, model: LanguageModel) -> np.ndarray:
    """log P(word | language) in log space, for words whose forward values leave a double's range."""
    _, ids, longest, byte_ids = _processor(model.vocab)
    s, window = MARK + word, [np.zeros(len(model.langs))]
    for j in range(1, len(s) + 1):
        terms = []
        for back, before in enumerate(reversed(window), 1):
            at = ids.get(s[j - back:j])
            if at is not None:
                terms.append(before + np.log(model.prob[at]))
            elif back == 1:
                at = byte_ids[list(s[j - 1].encode("utf-8", "replace"))]
                terms.append(before + np.log(model.prob[at]).sum(0))
        window = [*window[-(longest - 1):], np.logaddexp.reduce(terms)]
    return window[-1]


class _Trie:
    """The vocabulary's pieces as a trie whose steps are array lookups, for many words at a time.

    A step's key (state, character) is looked up in a hash table with open addressing; a state
    without the step ends the walk, so no longer substring is asked for.
    """

    def __init__(self, ids: dict[str, int]) -> None:
        letters = sorted({c for p in ids for c in p})
        self.letter = np.zeros(0x110000, np.int64)                # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        states: dict[str, int] = {"": 0}
        keys, values = [], []
        for p in sorted(ids):
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    keys.append(states[p[:k - 1]] * self.width + self.letter[ord(p[k - 1])])
                    values.append(states[p[:k]])
        self.piece = np.full(len(states), -1, np.int64)
        self.piece[[states[p] for p in ids]] = list(ids.values())
        self.bits = (4 * len(keys)).bit_length()
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, values = np.array(keys, np.int64), np.array(values, np.int64)
        at = self.place(left)
        while len(left):
            free = np.flatnonzero(self.key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.key[at[put]], self.value[at[put]] = left[put], values[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, values, at = left[rest], values[rest], (at[rest] + 1) & (len(self.key) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        keys = state * self.width + letter
        out = np.full(len(keys), -1, np.int64)
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            got = self.key[at]
            hit = got == keys[left]
            out[left[hit]] = self.value[at[hit]]
            go = ~hit & (got >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.key) - 1)
        return out


_tries: dict[str, _Trie] = {}


def _trie(path: str) -> _Trie:
    if path not in _tries:
        _tries[path] = _Trie(_processor(path)[1])
    return _tries[path]


def forward(words: list[str], model: LanguageModel) -> np.ndarray:
    """log P(word | language), summed over all segmentations; shape (words, languages)."""
    out = np.zeros((len(words), len(model.langs)))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    a = 0
    while a < len(order):
        # words of like length, so many that their characters and forward values stay bounded
        n = max(1, min(ROWS, ROW_LETTERS // (len(words[order[a]]) + 1)))
        rows = order[a:a + n]
        while len(rows) > 1 and (len(words[rows[-1]]) + 1) * len(rows) > 2 * ROW_LETTERS:
            rows = rows[:len(rows) // 2]
        out[rows] = _forward([words[k] for k in rows], model)
        a += len(rows)
    return out


def _forward(words: list[str], model: LanguageModel) -> np.ndarray:
    """Of words in order of length: a walk through the trie from every character, all words together."""
    _, ids, longest, byte_ids = _processor(model.vocab)
    trie, width = _trie(model.vocab), longest + 1
    size = np.array([len(w) + 1 for w in words])
    points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    start = np.cumsum(size) - size
    # a character that is no piece costs its bytes' pieces: a row of its own behind the model's
    single = trie.piece[np.maximum(trie.step(np.zeros(len(points), np.int64), trie.letter[points]), 0)]
    odd, row = np.unique(points[single < 0], return_inverse=True)
    prob = model.prob
    if len(odd):
        prob = np.vstack([prob, [np.prod(prob[byte_ids[list(chr(c).encode("utf-8", "replace"))]], axis=0) for c in odd]])
        single[single < 0] = len(model.prob) + row
    letter = trie.letter[points]
    ahead = np.zeros((width, len(words), prob.shape[1]))         # forward values at the next positions
    ahead[0] = 1
    scale, out = np.zeros((len(words), prob.shape[1])), np.zeros((len(words), prob.shape[1]))
    low = np.zeros(len(words), bool)
    for j in range(int(size[-1]) + 1):
        now = ahead[j % width]
        low |= (now < TINY).any(1) & (size >= j)
        first, after = np.searchsorted(size, [j, j + 1])
        if after > first:                                         # words that end here
            with np.errstate(divide="ignore"):
                out[first:after] = scale[first:after] + np.log(now[first:after])
        at = np.arange(after, len(words))
        if not len(at):
            break
        if j % RESCALE == 0 and j:
            top = ahead[:, at].max(0)
            top[low[at]] = 1
            ahead[:, at] /= top
            scale[at] += np.log(top)
        state = np.zeros(len(at), np.int64)
        for back in range(longest):
            place = start[at] + j + back
            state = trie.step(state, letter[place])
            piece = single[place] if back == 0 else np.where(state >= 0, trie.piece[state], -1)
            known = piece >= 0
            hit = at[known]
            ahead[(j + back + 1) % width, hit] += now[hit] * prob[piece[known]]
            on = (state >= 0) & (size[at] > j + back + 1)
            at, state = at[on], state[on]
            if not len(at):
                break
        ahead[j % width] = 0
    for k in np.flatnonzero(low):
        out[k] = _log_forward(words[k], model)
    return out


class _Store:
    """Log probabilities of words that a worker has summed, for one model."""
    model = ""
    slot: dict[str, int] = {}
    logp = np.zeros((0, 0))


def _empty() -> None:
    _Store.model, _Store.slot, _Store.logp = "", {}, np.zeros((0, 0))
    _pieces.clear()
    _tries.clear()


worker_stores["langid"] = _empty


def stored_forward(words: list[str], model: LanguageModel) -> np.ndarray:
    """``forward``, words of earlier batches from the store."""
    if _Store.model != model.key:
        _Store.slot = {}
        _Store.model, _Store.logp = model.key, np.zeros((0, len(model.langs)))
    new = [w for w in words if w not in _Store.slot]
    _Store.slot.update(zip(new, range(len(_Store.slot), len(_Store.slot) + len(new)), strict=True))
    _Store.logp = np.concatenate([_Store.logp, forward(new, model)])
    out = _Store.logp[np.fromiter(map(_Store.slot.__getitem__, words), np.int64, len(words))]
    if len(_Store.slot) > STORE_WORDS:
        short = [k for k, w in enumerate(words) if len(w) <= STORE_CHARS]
        _Store.slot = {words[k]: i for i, k in enumerate(short)}
        _Store.logp = out[short]
    elif any(len(w) > STORE_CHARS for w in new):
        short = [w for w in _Store.slot if len(w) <= STORE_CHARS]
        _Store.logp = _Store.logp[[_Store.slot[w] for w in short]]
        _Store.slot = {w: i for i, w in enumerate(short)}
    return out


def _predict(model: LanguageModel, text_col: str):
    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, text_col, BATCH_BYTES):
                col = batch.column(batch.schema.get_field_index(text_col))
                said = np.array([t is not None and LETTER.search(t) is not None for t in texts(batch, text_col)], bool) & bool(model.langs)
                # an empty text at the end, so that every text's words end before others begin
                kept = pa.concat_arrays([pc.if_else(pa.array(said), pc.fill_null(col, ""), ""), pa.array([""], col.type)])
                split = pc.utf8_split_whitespace(kept)
                coded = split.flatten().dictionary_encode()
                logp = stored_forward(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), model)
                logp = logp[coded.indices.to_numpy()]
                logp[pc.equal(split.flatten(), "").to_numpy(zero_copy_only=False)] = 0       # blanks about a text
                at = split.offsets.to_numpy() - split.offsets.to_numpy()[0]
                pred, score = np.full(len(said), UND, object), np.zeros(len(said))
                if said.any():
                    cuts = np.stack([at[:-2][said], at[1:-1][said]], 1).ravel()
                    s = np.add.reduceat(logp, cuts, axis=0)[::2] + model.prior
                    best = s.argmax(1)
                    pred[said] = [model.langs[k] for k in best]
                    score[said] = 1 / np.exp(s - s[np.arange(len(best)), best][:, None]).sum(1)
                yield with_columns(batch, {"lang_pred": pa.array(pred, pa.string()), "lang_score": pa.array(score)})
    return run


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``lang_score`` (posterior of the prediction)."""
    schema = extended_schema(df, {"lang_pred": "string", "lang_score": "double"})
    return map_arrow(df, _predict(model, text_col), schema, store="langid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 5) == 0
    model = fit(docs.filter(~held_out))
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred",
                    F.col("lang_score").alias("score")))
