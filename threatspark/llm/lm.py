"""Language-model scoring by a probabilistic suffix tree (operator 4).

Symbols are words (A-Z lowered) and one end per document. The root predicts by
add-one unigram counts over all training tokens. A node is a context of one or
two preceding symbols (the start of a document counts as the end symbol). Its
next-symbol counts are kept if its divergence from the parent pays for them:
n * KL(node || parent) > 0.5 * symbols * ln(n). Next-symbol distributions are
smoothed by absolute discounting into the parent, so each sums to one; a token
is scored in the longest suffix that is a node.

A symbol of a node, and a context of two, occurs at least ``LEAST`` times in the
training rows; there is no other bound, so the tree grows with the corpus.

Work is laid out in blocks: each task turns its documents into blocks of token
numbers with the block's own sorted word list. What the blocks count (words, pairs,
triples, and each context's terms of the divergence) is summed by ranges of the hash
of the whole key over all blocks, and each block gets back the sums of its own keys.
So neither the driver nor any task holds the tree, and all records of a hot context
never meet in one task.

Defined results: null text is empty (one end token); a null ``train`` flag means
held out; repeated rows each count and are scored; ids may be null or repeated and
other columns are ignored; without training rows every count is 0 (N = V = 0).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ODD, mixed
from .common import crc_fold, free_shuffles, map_arrow, read_table, stored, sub_batches, texts, workers_import

LEAST = 2  # least training occurrences of a node's symbol and of a context of two
DISCOUNT = 0.75
BLOCK_BYTES = 8 << 20  # of text in a block, about
RANGE_KEYS = 1_000_000  # list entries summed in one group, about
WORD, PAIR, NODE1, TRIPLE, NODE2 = range(5)  # what a request or reply is about
INTS = ("<u1", "<u2", "<u4", "<i8")
BLOCK = "block bigint, ids array<{id}>, sizes binary, train binary, toks binary, words binary, n_tokens bigint, n_train bigint"


def _packed(x: np.ndarray) -> bytes:
    """The array's bytes, equal places of all items together, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(x: bytes, dtype: str, columns: int = 1) -> np.ndarray:
    n, width = int.from_bytes(x[:8], "little"), np.dtype(dtype).itemsize * columns
    planes = pa.decompress(x[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(dtype).reshape(n, -1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, by their differences."""
    return _packed(np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8")))


def _keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x, "<u8").ravel(), dtype=np.uint64)


def _ints(n: np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them, the width first."""
    most = int(n.max(initial=0))
    k = 0 if most < 1 << 8 else 1 if most < 1 << 16 else 2 if most < 1 << 32 else 3
    return bytes([k]) + _packed(n.astype(INTS[k]))


def _from_ints(x: bytes) -> np.ndarray:
    return _unpacked(x[1:], INTS[x[0]]).ravel().astype(np.int64)


def _blocks(id_type: pa.DataType):
    def run(batches):
        from xxhash import xxh3_64_intdigest
        end = np.array([xxh3_64_intdigest(b"")], np.uint64)
        for whole in batches:
            for batch in sub_batches(whole, "text", BLOCK_BYTES):
                sizes, parts = [], []
                for t in texts(batch, "text"):
                    own = (t or "").encode("utf-8", "surrogatepass").lower().split()
                    parts += [np.fromiter(map(xxh3_64_intdigest, own), np.uint64, len(own)), end]
                    sizes.append(len(own) + 1)
                words, toks = np.unique(np.concatenate(parts), return_inverse=True)
                sizes = np.array(sizes, "<u4")
                train = np.array([bool(x) for x in texts(batch, "train")], np.uint8)
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([sizes.tobytes()], pa.binary()), pa.array([train.tobytes()], pa.binary()),
                    pa.array([_packed(toks.astype("<u4"))], pa.binary()),
                    pa.array([_packed_keys(words)], pa.binary()), pa.array([len(toks)], pa.int64()),
                    pa.array([int(sizes[train == 1].sum())], pa.int64())],
                    names=["block", "ids", "sizes", "train", "toks", "words", "n_tokens", "n_train"])
    return run


def _several(parts: list[bytes]) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def _each(x: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(x):
        n = int.from_bytes(x[at:at + 8], "little")
        out.append(x[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _packed_terms(t: np.ndarray) -> bytes:
    """Terms of contexts: counts as integers; the parent's mass and the divergence, which only decide what is kept, as floats."""
    return _several([*(_ints(t[:, k].astype(np.int64)) for k in (0, 1, 4)), *(_packed(t[:, k].astype("<f4")) for k in (2, 3))])


def _terms_of(x: bytes) -> np.ndarray:
    n, symbols, total, low, kl = _each(x)
    return np.stack([_from_ints(n), _from_ints(symbols), _unpacked(low, "<f4").ravel(), _unpacked(kl, "<f4").ravel(), _from_ints(total)],
                    axis=1).astype(float)


REQUEST = "kind int, part int, block bigint, keys binary, vals binary"
REPLY = "block bigint, kind int, part int, vals binary, known bigint"


def _ranged(kind: int, keys: np.ndarray, vals: np.ndarray, bits: int, block: int):
    """Requests of keys and their values, one per range of the hash."""
    if not len(keys):
        return
    order = np.argsort(keys)
    keys, vals = keys[order], vals[order]
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    cuts = list(zip(first, [*first[1:], len(part)], strict=True))
    pack = _ints if vals.ndim == 1 else _packed_terms
    yield pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(cuts), pa.int32()), "part": pa.array(part[first].astype(np.int32)),
        "block": pa.array([block] * len(cuts), pa.int64()),
        "keys": pa.array([_packed_keys(keys[a:b]) for a, b in cuts], pa.binary()),
        "vals": pa.array([pack(vals[a:b]) for a, b in cuts], pa.binary())})


def _joined(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit keys of (context, symbol)."""
    return mixed(mixed(context + ODD) * ODD + symbol)


class _Block:
    """A block's tokens with its distinct pairs and, once pairs are counted, triples."""

    def __init__(self, row: dict) -> None:
        from xxhash import xxh3_64_intdigest
        self.block = row["block"]
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.toks = _unpacked(row["toks"], "<u4").ravel().astype(np.int64)
        self.words = _keys(row["words"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learnt = np.repeat(self.train, self.sizes)
        before = np.r_[np.int64(0), self.toks[:-1]]
        before[self.starts] = np.searchsorted(self.words, np.uint64(xxh3_64_intdigest(b"")))
        size = len(self.words)
        pairs, self.pair = np.unique(before * size + self.toks, return_inverse=True)
        self.first, self.second = pairs // size, pairs % size
        self.pair_key = _joined(self.words[self.first], self.words[self.second])
        self.pair_train = np.bincount(self.pair[self.learnt], minlength=len(pairs))

    def word_train(self) -> np.ndarray:
        return np.bincount(self.toks[self.learnt], minlength=len(self.words))

    def counted(self, got: dict) -> None:
        """Take in the counts of words and pairs; lay out triples and contexts."""
        self.word_n = self.reply(got, WORD, self.words)
        pair_n = self.reply(got, PAIR, self.pair_key)
        self.pair_n, self.pair_mine = pair_n >> 1, (pair_n & 1) > 0
        self.ctx1 = np.unique(self.first[self.word_n[self.first] >= LEAST])
        inner = np.ones(len(self.toks), bool)
        inner[self.starts] = False
        inner[(self.starts + 1)[self.sizes > 1]] = False
        at = np.flatnonzero(inner)
        self.at2 = at[self.pair_n[self.pair[at - 1]] >= LEAST]  # tokens after a context of two
        self.ctx2 = np.unique(self.pair[self.at2 - 1])
        self.at3 = self.at2[self.pair_n[self.pair[self.at2]] >= LEAST]
        triples, self.triple = np.unique(self.pair[self.at3 - 1] * len(self.words) + self.toks[self.at3],
                                         return_inverse=True)
        self.ctx, self.next = triples // len(self.words), triples % len(self.words)
        self.triple_key = _joined(self.pair_key[self.ctx], self.words[self.next])
        self.triple_train = np.bincount(self.triple[self.learnt[self.at3]], minlength=len(triples))

    def reply(self, got: dict, kind: int, keys: np.ndarray) -> np.ndarray:
        """The sums of this block's keys, in their order."""
        out = np.zeros(len(keys), np.int64)
        if len(keys):
            out[np.argsort(keys)] = np.concatenate([_from_ints(x) for _, x in sorted(got.get(kind, []))])
        return out

    def rest(self, got: dict, kind: int, keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Weight of the parent in these contexts, 0 for no node."""
        out = np.zeros(len(keys))
        if len(keys):
            lost, symbols = (np.concatenate([_from_ints(x) for x in part])
                             for part in zip(*(_each(x) for _, x in sorted(got.get(kind, []))), strict=True))
            order = np.argsort(keys)
            out[order] = np.where(symbols > 0, (lost + DISCOUNT * symbols) / np.maximum(total[order], 1), 0)
        return out

    def pair_prob(self, got: dict, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(root probability of words, probability at depth 1 of pairs, weight of the root per word, 0 for no node)."""
        root = (self.word_n + 1) / scale
        rest = np.zeros(len(self.words))
        rest[self.ctx1] = self.rest(got, NODE1, self.words[self.ctx1], self.word_n[self.ctx1])
        own = rest[self.first]
        share = np.where(self.pair_n >= LEAST, self.pair_n - DISCOUNT, 0) / np.maximum(self.word_n[self.first], 1)
        low = root[self.second]
        return root, np.where(own > 0, low * own + share, low), rest

    def pair_rest(self, got: dict) -> np.ndarray:
        """Weight of depth 1 in the context of each pair, 0 for no node."""
        rest = np.zeros(len(self.pair_n))
        rest[self.ctx2] = self.rest(got, NODE2, self.pair_key[self.ctx2], self.pair_n[self.ctx2])
        return rest


def _terms(ctx: np.ndarray, size: int, total: np.ndarray, mine: np.ndarray, n: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """A block's terms per context: (occurrences, symbols, parent's mass, divergence), and the context's total.

    Of all blocks with a (context, symbol), one has its term; contexts without any are all zero.
    """
    use = (n >= LEAST) & mine
    ctx, n, parent = ctx[use], n[use], parent[use]
    p = n / total[ctx]
    terms = [np.bincount(ctx, x, size) for x in (n, np.ones(len(n)), parent, p * np.log(p / parent))]
    return np.stack([*terms, np.where(terms[1] > 0, total, 0)], axis=1)


def _first_requests(bits: int):
    """Training counts of a block's words and pairs."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own = _Block(row)
                yield from _ranged(WORD, own.words, own.word_train(), bits, own.block)
                yield from _ranged(PAIR, own.pair_key, own.pair_train, bits, own.block)
    return run


def _summed(table: pa.Table) -> pa.Table:
    """Per block the sums of its keys; one row without block has the number of words learnt."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    table = table.sort_by("block")
    own = [_keys(x) for x in table.column("keys").to_pylist()]
    keys, first, at = np.unique(np.concatenate(own), return_index=True, return_inverse=True)
    vals = table.column("vals").to_pylist()
    if kind in (NODE1, NODE2):
        v = np.concatenate([_terms_of(x) for x in vals])
        total = np.zeros(len(keys))
        some = v[:, 4] > 0
        total[at[some]] = v[some, 4]
        n, symbols, low, kl = (np.bincount(at, v[:, k], len(keys)) for k in range(4))
        size = np.maximum(total, 1)
        rest = (total - n) / size
        low = np.maximum(1 - low, 1e-12)
        kl += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / low), 0)
        kept = (symbols > 0) & (total * kl > 0.5 * symbols * np.log(np.maximum(total, 2)))
        lost, symbols = np.where(kept, total - n, 0).astype(np.int64), np.where(kept, symbols, 0).astype(np.int64)
        cuts = np.cumsum([len(x) for x in own])[:-1]
        replies = [_several([_ints(a), _ints(b)]) for a, b in zip(np.split(lost[at], cuts), np.split(symbols[at], cuts), strict=True)]
    else:
        out = np.bincount(at, np.concatenate([_from_ints(x) for x in vals]), len(keys)).astype(np.int64)
        known = int((out > 0).sum())
        if kind != WORD:
            out[out < LEAST] = 0
        back = out[at]
        if kind in (PAIR, TRIPLE):  # twice the count, one more in the first block that has the key
            back <<= 1
            back[first[out > 0]] += 1
        replies = [_ints(x) for x in np.split(back, np.cumsum([len(x) for x in own])[:-1])]
    blocks, known = table.column("block").to_pylist(), known if kind == WORD else 0
    n = len(blocks) + 1
    return pa.table({
        "block": pa.array([*blocks, None], pa.int64()), "kind": pa.array([kind] * n, pa.int32()),
        "part": pa.array([part] * n, pa.int32()), "vals": pa.array([*replies, None], pa.binary()),
        "known": pa.array([*[None] * len(blocks), known], pa.int64())})


def _opened(block: pa.Table, replies: pa.Table) -> tuple[_Block, dict]:
    got: dict[int, list] = {}
    for kind, part, vals in zip(*(replies.column(c).to_pylist() for c in ("kind", "part", "vals")), strict=True):
        got.setdefault(kind, []).append((part, vals))
    own = _Block(block.to_pylist()[0])
    own.counted(got)
    return own, got


def _table(batches, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)


REQUEST_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()),
                           ("vals", pa.binary())])


def _second_requests(bits: int, scale: int):
    """Terms of the contexts of one word, and training counts of triples."""
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table([], REQUEST_ARROW)
        own, _ = _opened(block, replies)
        root = (own.word_n + 1) / scale
        terms = _terms(own.first, len(own.words), own.word_n, own.pair_mine, own.pair_n, root[own.second])
        return _table([*_ranged(NODE1, own.words[own.ctx1], terms[own.ctx1], bits, own.block),
                       *_ranged(TRIPLE, own.triple_key, own.triple_train, bits, own.block)], REQUEST_ARROW)
    return run


def _third_requests(bits: int, scale: int):
    """Terms of the contexts of two words."""
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _table([], REQUEST_ARROW)
        own, got = _opened(block, replies)
        above = own.pair_prob(got, scale)[1]
        n = own.reply(got, TRIPLE, own.triple_key)
        parent = np.zeros(len(n))
        parent[own.triple] = above[own.pair[own.at3]]
        terms = _terms(own.ctx, len(own.pair_n), own.pair_n, (n & 1) > 0, n >> 1, parent)
        return _table(_ranged(NODE2, own.pair_key[own.ctx2], terms[own.ctx2], bits, own.block), REQUEST_ARROW)
    return run


TREE = "depth int, two bigint, one bigint, symbol bigint, rest double, prob double"


def _tree_rows(scale: int):
    """(depth, context, symbol, rest, prob) of the nodes that occur in a block, words as hashes."""
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in TREE.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not block.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        own, got = _opened(block, replies)
        rest1, rest2 = own.pair_prob(got, scale)[2], own.pair_rest(got)
        n = own.reply(got, TRIPLE, own.triple_key) >> 1
        words = own.words.view(np.int64)
        a = np.flatnonzero((rest1[own.first] > 0) & (own.pair_n >= LEAST))
        b = np.flatnonzero((rest2[own.ctx] > 0) & (n >= LEAST))
        q = own.ctx[b]
        cols = [(np.full(len(a), 1), np.full(len(b), 2)), (np.zeros(len(a), np.int64), words[own.first[q]]),
                (words[own.first[a]], words[own.second[q]]), (words[own.second[a]], words[own.next[b]]),
                (rest1[own.first[a]], rest2[q]),
                ((own.pair_n[a] - DISCOUNT) / own.word_n[own.first[a]], (n[b] - DISCOUNT) / own.pair_n[q])]
        return pa.table([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)
    return run


@dataclass
class SuffixTree:
    """Nodes by depth, as arrays; ``words`` are the sorted hashes of the words in them."""

    words: np.ndarray
    end: int                   # number of the end symbol, -1 if no node has it
    total: int                 # N
    vocabulary: int            # V
    ctx: list[np.ndarray]      # per depth: sorted node keys
    rest: list[np.ndarray]     # weight of the parent in each node
    keys: list[np.ndarray]     # sorted node key * (alphabet + 1) + symbol
    prob: list[np.ndarray]     # discounted share of the symbol


def _gathered(rows: DataFrame, total: int, vocabulary: int) -> SuffixTree:
    """The whole tree on the driver, to look into that of a small table."""
    from xxhash import xxh3_64_intdigest
    got = rows.distinct().toArrow()
    depth, two, one, symbol, rest, prob = (got.column(c).to_numpy() for c in got.column_names)
    two, one, symbol = (x.astype(np.int64).view(np.uint64) for x in (two, one, symbol))
    words = np.unique(np.concatenate([two[depth == 2], one, symbol]))
    end = np.flatnonzero(words == np.uint64(xxh3_64_intdigest(b"")))
    tree = SuffixTree(words, int(end[0]) if len(end) else -1, total, vocabulary, [], [], [], [])
    size = len(words)
    for d in (1, 2):
        use = depth == d
        ctx = np.searchsorted(words, one[use])
        if d == 2:
            ctx = np.searchsorted(words, two[use]) * size + ctx
        keys = ctx * (size + 1) + np.searchsorted(words, symbol[use])
        order = np.argsort(keys)
        nodes, at = np.unique(ctx, return_index=True)
        for held, x in ((tree.ctx, nodes), (tree.rest, rest[use][at]), (tree.keys, keys[order]),
                        (tree.prob, prob[use][order])):
            held.append(x)
    return tree


def _scores(scale: int, id_type: pa.DataType):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["id", "train", "n_tokens", "n_known", "base_score", "score"]
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(),
                                                       pa.float64())], names=names)
        own, got = _opened(block, replies)
        root, above, _ = own.pair_prob(got, scale)
        known, base, p = own.word_n[own.toks] > 0, root[own.toks], above[own.pair]
        rest = own.pair_rest(got)
        n = np.zeros(len(p), np.int64)
        n[own.at3] = own.reply(got, TRIPLE, own.triple_key)[own.triple] >> 1
        at = own.at2[rest[own.pair[own.at2 - 1]] > 0]
        q = own.pair[at - 1]
        p[at] = p[at] * rest[q] + np.where(n[at] >= LEAST, n[at] - DISCOUNT, 0) / own.pair_n[q]
        ids = block.column("ids").combine_chunks().values.slice(0, len(own.sizes))
        return pa.table([ids, pa.array(own.train), pa.array(own.sizes),
                         pa.array(np.add.reduceat(known.astype(np.int64), own.starts)),
                         pa.array(np.add.reduceat(np.log10(base), own.starts)),
                         pa.array(np.add.reduceat(np.log10(p), own.starts))], names=names)
    return run


def fit_and_score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                  out: list | None = None) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The tree is learnt from the rows where ``train`` is true; ``out``, if given, gets it (the
    whole tree on the driver: for small tables).
    """
    spark = df.sparkSession
    workers_import(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     F.coalesce(train, F.lit(False)).alias("train"))
    id_type = docs.schema["id"].dataType.simpleString()
    arrow_id = pa.int64() if id_type == "bigint" else docs.select("id").limit(0).toArrow().schema[0].type
    data = stored(map_arrow(docs, _blocks(arrow_id), BLOCK.format(id=id_type)), "blocks")
    tokens, total = data.agg(F.coalesce(F.sum(F.octet_length("toks") / 4), F.lit(0)).cast("long"),
                             F.coalesce(F.sum("n_train"), F.lit(0))).first()
    bits = max(6, (tokens // RANGE_KEYS).bit_length())

    def summed(requests: DataFrame, name: str) -> DataFrame:
        return stored(requests.groupBy("kind", "part").applyInArrow(_summed, REPLY), name)

    def met(replies: DataFrame, fn, schema: str) -> DataFrame:
        own = replies.filter("block is not null")
        return data.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(fn, schema)

    replies = summed(map_arrow(data, _first_requests(bits), REQUEST), "counts")
    free_shuffles(spark)
    vocabulary = replies.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    scale = total + vocabulary + 1
    replies = replies.union(summed(met(replies, _second_requests(bits, scale), REQUEST), "triples"))
    free_shuffles(spark)
    replies = replies.union(summed(met(replies, _third_requests(bits, scale), REQUEST), "nodes"))
    free_shuffles(spark)
    if out is not None:
        out.append(_gathered(met(replies, _tree_rows(scale), TREE), total, vocabulary))
    schema = f"id {id_type}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    return (met(replies, _scores(scale, arrow_id), schema)
            .select(F.col("id").alias(id_col), "train", "n_tokens", "n_known",
                    F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (fit_and_score(docs, crc_fold("doc_id", 7) != 2)
            .select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score"))
