"""Long stretches that stand verbatim in more than one document, by suffix trees partitioned by prefixes.

A tree of all suffixes to a depth of ``length`` would shuffle each character ``length`` times.
It isn't needed: only suffixes that begin at *anchors* are kept. Among the ``window`` seeds
(32 characters) that begin a stretch of ``length`` characters the one with the least hash is
an anchor; the choice looks at the stretch only, so every document that holds the stretch
has an anchor at the same place of it, with at least ``length - window + 1`` equal characters
to the right. Suffixes are partitioned by that prefix, and where more begin with it than a
worker should hold, by longer ones, up to the full length (:func:`longer_prefixes`). Each
group's suffix tree is built by a worker (:mod:`treeline.llm.suffixes`); its deep internal nodes
give the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.suffixes import Forest
from treeline.plans.lineage import cut

LENGTH = 400
SEED = 32
WINDOW = 201
#: Suffixes of a group up to this many are one tree in a worker's memory (about 5 kB each); more are split by longer prefixes.
MOST_IN_GROUP = 8_192
#: Documents of one repeat are paired in blocks of this many, so that no row and no task holds the pairs of a large repeat.
PAIRED = 256
#: Characters hashed at a time, so that arrays stay in the processor's cache.
SEGMENT = 1 << 17
#: Characters of texts taken together.
BLOCK = 1 << 21

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


_POWER = {1 << i: np.uint64(pow(int(_A), 1 << i, 1 << 64)) for i in range(20)}


def rolling(codes: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all stretches of the given sizes along the last axis, put together from those of powers of two."""
    h = {1: _mix(codes.astype(np.uint64) * _A + np.uint64(0x632BE59BD9B4E019))}
    out, k, largest = {}, 1, max(sizes)
    while 2 * k <= largest:
        h[2 * k] = h[k][..., :-k] * _POWER[k] + h[k][..., k:]
        k *= 2
    n = codes.shape[-1]
    for size in sizes:
        total, at = None, 0
        for bit in sorted((b for b in h if size & b), reverse=True):
            part = h[bit][..., at : at + n - size + 1]
            total = part if total is None else total * _POWER[bit] + part
            at += bit
        out[size] = total
    return out


def anchors(codes: np.ndarray, allowed: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and hashes of the prefix that begins there.

    ``allowed`` marks where a stretch of ``length`` may begin. Ties go to the first place.
    """
    prefix = length - window + 1
    places, keys = [], []
    n = len(codes)
    for at in range(0, max(n - length + 1, 0), SEGMENT):
        part = codes[at : at + SEGMENT + length - 1]
        ok = allowed[at : at + min(SEGMENT, len(part) - length + 1)]
        if not ok.any():
            continue
        h = rolling(part, (SEED, prefix))
        order = (_mix(h[SEED]) & ~np.uint64(0xFFFFFF)) | np.arange(len(h[SEED]), dtype=np.uint64)
        k = 1
        while 2 * k <= window:
            order = np.minimum(order[:-k], order[k:])
            k *= 2
        if k < window:
            order = np.minimum(order[: k - window], order[window - k :])
        found = np.unique((order[: len(ok)][ok] & np.uint64(0xFFFFFF)).astype(np.int64))
        places.append(found + at)
        keys.append(h[prefix][found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(keys)[first].view(np.int64)


class Block:
    """Texts one after the other as code points."""

    def __init__(self, texts: list[str], length: int = LENGTH, window: int = WINDOW) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        allowed = np.zeros(len(self.codes) + 1, np.int8)
        for s, e in zip(self.starts, self.ends, strict=True):
            if e - s >= length:
                allowed[s] += 1
                allowed[e - length + 1] -= 1
        self.place, self.key = anchors(self.codes, np.cumsum(allowed[:-1]).astype(bool), length, window)
        self.text = np.searchsorted(self.ends, self.place, side="right")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of at most about BLOCK characters, and their texts (the second column)."""
    texts = batch.column(1).to_pylist()
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield at, i, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts), texts[at:]


def anchor_keys(texts: DataFrame, length: int, window: int) -> DataFrame:
    """``doc``, ``key``, ``n``: the distinct prefixes of anchors of each text, and how many anchors have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, part in _blocks(batch):
                b = Block(part, length, window)
                order = np.lexsort((b.key, b.text))
                t, k = b.text[order], b.key[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(t)))
                yield pa.record_batch([pa.array(docs[at + t[heads]]), pa.array(k[heads]), pa.array(n)], names=["doc", "key", "n"])

    return texts.select("doc", "text").mapInArrow(run, "doc bigint, key bigint, n bigint")


CONTEXT = "key bigint, check bigint, doc bigint, first bigint, last bigint, before int, after int, context string"


def contexts(texts: DataFrame, length: int, window: int) -> DataFrame:
    """The anchors whose prefix is in the text's ``keys``, with the characters around each.

    ``context`` holds the ``window - 1`` characters before the prefix and as many after it,
    filled up outside the text; ``before`` and ``after`` say how many are real. The prefix
    itself is the same within a group: ``key`` and ``check``, two independent hashes of it,
    stand for it. Anchors of a text with the same context and less than ``length`` apart (long
    runs of one character) are one row from ``first`` to ``last``.
    """
    left, prefix = window - 1, length - window + 1
    around = np.concatenate([np.arange(-left, 0), np.arange(prefix, length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            for at, to, part in _blocks(batch):
                b = Block(part, length, window)
                own = lists.slice(at, to - at)
                offsets = own.offsets.to_numpy()
                wanted = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(to - at), np.diff(offsets))
                tag = lambda text, key: key.view(np.uint64) ^ _mix(text.astype(np.uint64) * _A + np.uint64(1))
                keep = np.isin(tag(b.text, b.key), tag(owner, wanted))
                yield from emit(b, docs[at:to], np.flatnonzero(keep))

    def hashed(chars: np.ndarray) -> np.ndarray:
        return (_mix(chars.astype(np.uint64) + np.arange(chars.shape[1], dtype=np.uint64) * _B) * _A).sum(1, dtype=np.uint64)

    def emit(b: Block, docs: np.ndarray, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(chosen), 4096):
            c = chosen[i : i + 4096]
            place, text, key = b.place[c], b.text[c], b.key[c]
            check = hashed(b.codes[place[:, None] + np.arange(prefix)]).view(np.int64)
            where = place[:, None] + around
            inside = (where >= b.starts[text][:, None]) & (where < b.ends[text][:, None])
            chars = np.where(inside, b.codes[np.clip(where, 0, len(b.codes) - 1)], 0).astype(np.uint32)
            before, after = inside[:, :left].sum(1), inside[:, left:].sum(1)
            same = hashed(chars) ^ key.view(np.uint64)
            order = np.lexsort((place, same, before, after, text))
            p, s, t = place[order], same[order], text[order]
            new = np.ones(len(p), bool)
            if len(p):
                new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (np.diff(p) >= length)
            heads = np.flatnonzero(new)
            lasts = np.append(heads[1:], len(p)) - 1
            row = order[heads]
            joined = chars[row].tobytes().decode("utf-32-le", "surrogatepass")
            width = chars.shape[1]
            strings = [joined[k : k + width] for k in range(0, len(joined), width)]
            begin = b.starts[t[heads]]
            yield pa.record_batch(
                [
                    pa.array(key[row]), pa.array(check[row]), pa.array(docs[t[heads]]), pa.array(p[heads] - begin), pa.array(p[lasts] - begin),
                    pa.array(before[row].astype(np.int32)), pa.array(after[row].astype(np.int32)), pa.array(strings, pa.string()),
                ],
                names=["key", "check", "doc", "first", "last", "before", "after", "context"],
            )

    return texts.select("doc", "text", "keys").mapInArrow(run, CONTEXT)


def _blocks_of(repeat: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents of repeats as matrices ``a`` and ``b``: the pairs are ``a[i, j] < b[i, k]``. Repeats of the same documents count once."""
    heads = np.flatnonzero(np.append(True, repeat[1:] != repeat[:-1]))
    sizes = np.diff(np.append(heads, len(repeat)))
    for n in np.unique(sizes):
        sets = np.unique(doc[heads[sizes == n][:, None] + np.arange(n)], axis=0)
        if n <= PAIRED:
            yield sets[:, :-1], sets[:, 1:]
            continue
        for i in range(0, n, PAIRED):
            for j in range(i, n, PAIRED):
                yield sets[:, i : i + PAIRED], sets[:, j : j + PAIRED]


def match_groups(suffixes: DataFrame, length: int, window: int, spans: bool) -> DataFrame:
    """Builds the trees of groups (``key``, ``check``) of suffixes, each in one task.

    With ``spans``, the shared stretch around each suffix (``doc``, ``start``, ``end``); else
    the documents of each maximal repeat, in blocks to be paired (``docs_a``, ``docs_b``).
    """
    prefix, left = length - window + 1, window - 1
    numbers = ("key", "check", "doc", "first", "last", "before", "after")

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in numbers}
        text = "".join(batch.column("context").to_pylist())
        out["chars"] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(batch.num_rows, 2 * left)
        return out

    def results(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(c["key"]):
            return
        group = np.cumsum(np.append(False, (c["key"][1:] != c["key"][:-1]) | (c["check"][1:] != c["check"][:-1])))
        # most suffixes are alone with their prefix
        many = np.bincount(group)[group] > 1
        c, group = {k: v[many] for k, v in c.items()}, group[many]
        if not len(group):
            return
        forest = Forest(group, c["doc"], c["before"], c["after"], c["chars"])
        if spans:
            rows, l, r = forest.extents()
            found = np.stack([c["doc"][rows], c["first"][rows] - l, c["last"][rows] + prefix + r], 1)
            found = np.unique(found, axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], names=["doc", "start", "end"])
            return
        for repeat, doc in forest.repeats():
            for a, b in _blocks_of(repeat, doc):
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))
                step = max(1, (1 << 20) // a.shape[1])
                for at in range(0, len(a), step):
                    yield pa.record_batch([lists(a[at : at + step]), lists(b[at : at + step])], names=["docs_a", "docs_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # rows of the key that may go on in the next batch
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                c = columns(batch.slice(at, 4096))
                end = int(np.searchsorted(c["key"], c["key"][-1], side="left"))
                if end or held and held[-1]["key"][-1] != c["key"][0]:
                    done = [*held, {k: v[:end] for k, v in c.items()}]
                    yield from results({k: np.concatenate([x[k] for x in done]) for k in c})
                    held = []
                held.append({k: v[end:] for k, v in c.items()})
        if held:
            yield from results({k: np.concatenate([x[k] for x in held]) for k in held[0]})

    # partitioned by an expression of its own: a repartition that repeats a join's may be left out, and the join changed later
    grouped = suffixes.select(*numbers, "context").repartition(F.xxhash64("key", F.lit(1))).sortWithinPartitions("key", "check")
    return grouped.mapInArrow(run, "doc bigint, start bigint, `end` bigint" if spans else "docs_a array<bigint>, docs_b array<bigint>")


def block_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """``docs_a``, ``docs_b`` of groups of documents (``keys``, ``doc``, each once), however large: the pairs are all of a with all of b.

    A group is dealt out by a hash of the document into blocks of about ``PAIRED``; each two
    blocks of it meet in a row of their own, so no task gets a whole group.
    """
    blocks = F.ceil(F.count(F.lit(1)) / PAIRED).cast("long")
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), blocks.alias("k")).filter("n > 1").select(*keys, "k")
    placed = members.join(sizes, keys).withColumn("b", F.pmod(F.xxhash64("doc"), F.col("k")))
    lists = placed.groupBy(*keys, "k", "b").agg(F.collect_list("doc").alias("docs"))
    a = lists.select(*keys, F.col("b").alias("i"), F.explode(F.expr("sequence(b, k - 1)")).alias("j"), F.col("docs").alias("docs_a"))
    b = lists.select(*keys, F.explode(F.expr("sequence(0L, b)")).alias("i"), F.col("b").alias("j"), F.col("docs").alias("docs_b"))
    return a.join(b, [*keys, "i", "j"]).select("docs_a", "docs_b")


def _pairs(blocks: DataFrame) -> DataFrame:
    """``doc_a < doc_b``, each once. Neighbouring repeats mostly have the same documents, and fall together before they are paired."""
    apart = blocks.distinct().select(F.explode("docs_a").alias("a"), "docs_b").select("a", F.explode("docs_b").alias("b")).filter("a <> b")
    return apart.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


NODE = "n1 bigint, n2 bigint, key bigint, check bigint, doc bigint, first bigint, start bigint, `end` bigint"


def longer_prefixes(suffixes: DataFrame, length: int, window: int, step: int) -> DataFrame:
    """Suffixes of hot prefixes under longer ones: ``n1``, ``n2`` (the hashes of a node), and the stretch ``start``, ``end``.

    A shared stretch begins at one of ``window`` places before the prefix. With a ``step`` of
    1 there is a node for each place, a stretch of full length whose members all share it.
    With a larger step there is one for each run of ``step`` places: the part that any stretch
    beginning there holds, ``step - 1`` shorter; suffixes that share no such node share nothing.
    """
    left = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = "".join(part.column("context").to_pylist())
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(part.num_rows, -1)
                get = lambda k: part.column(k).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                key, check, doc, first, last, before, after = map(get, ("key", "check", "doc", "first", "last", "before", "after"))
                size = left - step + 1
                places = np.arange(0, left + 1, step)
                begin = np.minimum(places + step - 1, left)  # the last place of a run may be cut
                one = rolling(chars, (size,))[size][:, begin]
                two = rolling(chars ^ np.uint32(0x5BD1E995), (size,))[size][:, begin]
                i, o = np.nonzero((before[:, None] >= left - begin) & (after[:, None] >= begin + size - left))
                mark = _mix(places[o].astype(np.uint64) * _A + np.uint64(3))
                node = [_mix(one[i, o] * _A + mark) ^ key[i].view(np.uint64), _mix(two[i, o] * _A + mark) ^ check[i].view(np.uint64)]
                t = left - begin[o]
                cols = [*[x.view(np.int64) for x in node], key[i], check[i], doc[i], first[i], first[i] - t, last[i] - t + length]
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in cols], names=["n1", "n2", "key", "check", "doc", "first", "start", "end"])

    return suffixes.mapInArrow(run, NODE)


def _shared_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of more than one document, with the number ``total`` of their suffixes."""
    many = nodes.groupBy("n1", "n2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("total")).filter("lo <> hi")
    return nodes.join(many.select("n1", "n2", "total"), ["n1", "n2"])


def _split_groups(suffixes: DataFrame, length: int, window: int, spans: bool, most: int) -> DataFrame:
    """What suffixes of prefixes too frequent for one tree share, by longer prefixes; as :func:`match_groups`.

    Prefixes are first lengthened to all but a quarter of the window, which tells most suffixes
    apart and leaves groups for a tree each. Suffixes that still share such a prefix with too
    many get prefixes of the full length: their nodes are deep as they are, and no tree is needed.
    """
    at = ["key", "check", "doc", "first"]
    kept = cut(suffixes)
    nodes = cut(_shared_nodes(longer_prefixes(kept, length, window, max(1, (window - 1) // 4))).select("n1", "n2", *at, "total"))
    fits = nodes.filter(F.col("total") <= most).join(kept, at)
    again = fits.select(F.col("n1").alias("key"), F.col("n2").alias("check"), "doc", "first", "last", "before", "after", "context")
    out = match_groups(again, length, window, spans)
    large = nodes.filter(F.col("total") > most).select(*at).distinct()
    full = _shared_nodes(longer_prefixes(kept.join(large, at, "left_semi"), length, window, 1))
    if spans:
        return out.unionByName(full.select("doc", "start", "end"))
    members = full.select("n1", "n2", "doc").distinct()
    # nodes of neighbouring offsets have the same members: one of each set is enough
    sets = members.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "doc")).alias("y"))
    one = sets.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("n1", "n2")).alias("s")).select("s.n1", "s.n2")
    return out.unionByName(block_pairs(cut(members.join(one, ["n1", "n2"], "left_semi")), ["n1", "n2"]))


def _texts(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    return rows.filter(F.length("text") >= length)


def copies_of(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """``rep``, ``doc``, ``n`` of documents whose whole text another one has, ``rep`` being the least id of the class.

    Only digests are shuffled. Texts shorter than ``length`` are left out.
    """
    every = _texts(docs, id_col, text_col, length).select("doc", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("n")).distinct()
    many = every.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("digest", "rep")
    return every.join(many, "digest").select("rep", "doc", F.col("n").cast("long").alias("n"))


def shared_stretches(
    docs: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, window: int | None = None, spans: bool = False, most_in_group: int = MOST_IN_GROUP
) -> DataFrame:
    """Pairs of different texts with an identical stretch of ``length`` code points, or the stretches themselves.

    Works on one document of each class of ``copies`` (:func:`copies_of`), the one with the
    least id. With ``spans``, rows ``doc``, ``start``, ``end`` cover exactly the characters of
    ``doc`` that lie in such a stretch; else ``doc_a < doc_b``, each pair once.

    Texts are read where they lie to find anchors; only ids and hashes of prefixes are
    shuffled. A second reading shuffles each text once, to meet the list of its shared prefixes.
    """
    window = window or min(WINDOW, length - SEED + 1, length // 2 + 1)
    texts = _texts(docs, id_col, text_col, length)
    keys = cut(anchor_keys(texts, length, window).join(copies.filter("doc <> rep").select("doc"), "doc", "left_anti"))
    # states of keys are combined before the shuffle, and a join can split a frequent key: no task gets all of its rows
    many = keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("n").alias("total")).filter("lo <> hi")
    shared = cut(keys.join(many.select("key", "total"), "key").select("doc", "key", "total"))

    def suffixes(rows: DataFrame) -> DataFrame:
        # the lists of prefixes are the smaller side, but grow with the data: never broadcast
        wanted = rows.groupBy("doc").agg(F.collect_list("key").alias("keys")).hint("shuffle_hash")
        return contexts(texts.join(wanted, "doc"), length, window)

    out = match_groups(suffixes(shared.filter(F.col("total") <= most_in_group)), length, window, spans)
    hot = shared.filter(F.col("total") > most_in_group)
    if not hot.isEmpty():
        out = out.unionByName(_split_groups(suffixes(hot), length, window, spans, most_in_group))
    return out.distinct() if spans else _pairs(out)


def sharing_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, **options) -> DataFrame:
    """``doc_a < doc_b`` of all documents, copies included, whose texts share a stretch of ``length`` code points.

    Pairs of classes are found first and each is then spread over the copies of both; copies of
    one text of at least ``length`` characters are pairs too. Null, empty and short texts have
    none; a stretch repeated within one document only is none; repeated rows count once.
    """
    copies = cut(copies_of(docs, id_col, text_col, length))
    pairs = shared_stretches(docs, copies, id_col, text_col, length=length, **options)
    spread = lambda t, c: t.join(copies.select(F.col("rep").alias(c), F.col("doc").alias("x")), c, "left").withColumn(c, F.coalesce("x", c)).drop("x")
    across = spread(spread(pairs, "doc_a"), "doc_b")
    within = _pairs(block_pairs(copies.select("rep", "doc").distinct(), ["rep"]))
    both = across.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).filter("doc_a <> doc_b")
    return both.unionByName(within).distinct()


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id``, ``start``, ``end`` of the longest runs of characters that all lie in a stretch shared with another document.

    Places count from 0, ``end`` is the first place behind. A run may be put together of
    stretches shared with different documents. A document of which another holds the whole
    text (of at least ``length``) is one run; documents that share nothing have none.
    """
    copies = cut(copies_of(docs, id_col, text_col, length))
    found = shared_stretches(docs, copies, id_col, text_col, length=length, spans=True, **options)
    # what is found of a class stands in each of its documents, but there the whole text is shared anyway
    found = found.join(copies.select("doc"), "doc", "left_anti")
    w = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = opened.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = runs.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc", "start", "end")
    whole = copies.select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    return merged.unionByName(whole).select(F.col("doc").alias(id_col), "start", "end")


def shared_amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id``, ``n_chars``, ``shared_chars`` of every document with an id.

    ``shared_chars`` counts the characters that lie in some stretch of at least ``length`` that
    stands verbatim in another document; all of them, where a copy of the whole text exists.
    Null texts have null ``n_chars`` and 0 shared.
    """
    spans = shared_spans(docs, id_col, text_col, length=length, **options)
    amounts = spans.groupBy(F.col(id_col).alias("doc")).agg(F.sum(F.col("end") - F.col("start")).alias("shared"))
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.length(text_col).cast("long").alias("n_chars"))
    return base.join(amounts, "doc", "left").select(F.col("doc").alias(id_col), "n_chars", F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"))
