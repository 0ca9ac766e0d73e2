"""Passages that repeat across documents.

*Paragraphs* are the lines of a text.  Equal ones (after lower-casing A-Z, with words
``[^\\x20\\x09-\\x0D]+``) form one class.  Classes get MinHash signatures over their five-word
shingles; classes that agree in one of ``BANDS`` bands of ``ROWS`` minima meet, and the exact
Jaccard similarity of their shingles decides.  Two paragraphs of similarity 0.75 miss
each other with probability (1 - 0.75**2)**12 = 5e-5.  A band's classes are first compared
with its smallest one, each such pair once whatever the bands it shares; only bands where
that leaves a class unlinked are compared in full.  Linked classes are clustered by components.

A passage may also be copied into the middle of a paragraph, or across lines.  Of every
``REACH`` successive runs of ``RUN_WORDS`` words the one of least hash is an *anchor*, in texts
of any length.  A passage of ``RUN_WORDS + REACH - 1`` words and more has the same anchors
wherever it stands; shorter ones, down to ``RUN_WORDS`` words, may have.  An anchor that
several documents hold is compared with its first occurrence word by word and widened
on both sides as far as the words agree; widened anchors that overlap and have their
source in one place are one passage.  Sources of one document that overlap are
one cluster, with that stretch as its kept copy.  What a document repeats
of itself within its lines is left.

In each cluster the first occurrence (smallest doc_id, then position) is kept.  Words in
lines that are not kept belong to no anchor and no widening, and a source always lies in a
document of smaller doc_id, so that every word removed stays somewhere.  A kept stretch
may hold words that are themselves removed as a copy from an earlier document.
Paragraphs of fewer than ``min_words`` words are not judged: such lines repeat by chance.
Null texts and texts without words have no passages; rows with a null doc_id are left
out; rows that repeat a doc_id hold the occurrences of one document.  Ties of hash go to the
leftmost run.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatledger.llm.common import (
    SHINGLE_WORDS,
    Scratch,
    components,
    min_hashes,
    mixed,
    odd_numbers,
    shingle_hashes,
    space_words,
    word_hashes,
)

BANDS, ROWS = 12, 2
MIN_WORDS = 5
#: Words of an anchor, and so of the shortest passage inside lines.
RUN_WORDS = 16
#: One of this many successive anchors is taken.
REACH = 25
#: Words of lines whose signatures are worked out together.
TOGETHER = 4096
#: Members of one side of a comparison within a task.
CHUNK = 512


def _line_bands(lines: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The bands of lines of shingles, a row a line; lines are taken together up to ``TOGETHER`` shingles."""
    at = 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to]) <= TOGETHER):
            size += len(lines[to])
            to += 1
        if to == at + 1:
            minima = min_hashes(lines[at], BANDS * ROWS, seed=23)[:, None]
        else:
            starts = np.cumsum([0, *(len(x) for x in lines[at : to - 1])])
            products = np.concatenate(lines[at:to])[None, :] * odd_numbers(BANDS * ROWS, 23)[:, None]
            minima = np.minimum.reduceat(products, starts, axis=1)
        lows = minima.T.reshape(-1, BANDS, ROWS)
        yield mixed((lows * odd_numbers(ROWS, 5)).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        at = to


def _lines(text: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """``(start, end, words)`` of every line, counted in words of the text."""
    at = 0
    for line in text.split(b"\n"):
        words = space_words(line)
        if words:
            yield at, at + len(words), words
        at += len(words)


def _anchors(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors of a text: the leftmost least of every ``REACH`` runs.
    The hash of a run is made of those of the shingles that cover it."""
    last = RUN_WORDS - SHINGLE_WORDS
    count = len(shingles) - last
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = [*range(0, last, SHINGLE_WORDS), last]
    runs = np.zeros(count, np.uint64)
    for place, factor in zip(places, odd_numbers(len(places), 41)):
        runs += shingles[place : place + count] * factor
    runs = mixed(runs)
    least = np.lib.stride_tricks.sliding_window_view(runs, min(REACH, count)).argmin(axis=1)
    least += np.arange(len(least))
    starts = least[np.flatnonzero(np.diff(least, prepend=-1))]
    return starts, runs[starts].view(np.int64)


def _cut(min_words: int):
    """Lines of texts with their class and bands, and anchors (``class`` null) with their hash."""
    line = [("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("anchor", pa.int64())]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), *line])

    def made(rows: list[tuple], bands: list[np.ndarray], found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if rows:
            doc, start, end, name = zip(*rows)
            flat = pa.array(np.concatenate(bands).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), flat)
            ints = [pa.array(x, pa.int64()) for x in (doc, start, end)]
            arrays = [*ints, pa.array(name, pa.binary()), lists, pa.nulls(len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if found:
            starts = np.concatenate([f[1] for f in found])
            ids = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            nulls = [pa.nulls(len(starts), t) for t in (pa.binary(), pa.list_(pa.int64()))]
            arrays = [pa.array(ids, pa.int64()), pa.array(starts), pa.array(starts + RUN_WORDS), *nulls]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([f[2] for f in found]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            bands: list[np.ndarray] = []
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            anchors = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                every = list(_lines(text.as_py()))
                hashes = word_hashes([w for x in every for w in x[2]])
                # Shingles of a line are a stretch of those of the text.
                shingles = shingle_hashes(hashes) if len(hashes) >= SHINGLE_WORDS else np.zeros(0, np.uint64)
                parts = []
                for start, end, words in every:
                    if end - start >= min_words:
                        rows.append((doc, start, end, xxhash.xxh3_128_digest(b" ".join(words))))
                        whole = end - start >= SHINGLE_WORDS
                        parts.append(shingles[start : end - SHINGLE_WORDS + 1] if whole else shingle_hashes(hashes[start:end]))
                bands.extend(_line_bands(parts))
                found.append((doc, *_anchors(shingles)))
                anchors += len(found[-1][1])
                if len(rows) > 20_000 or anchors > 200_000:
                    yield from made(rows, bands, found)
                    rows, bands, found, anchors = [], [], [], 0
            yield from made(rows, bands, found)

    return run


def _class_texts(min_words: int):
    schema = pa.schema([("node", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``node, words`` of the classes that have their first place in a text."""
        for batch in batches:
            rows: dict[str, list] = {"node": [], "words": []}
            for text, places in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                wanted = {p["start"]: p for p in places}
                for start, end, words in _lines(text.as_py()):
                    if end - start >= min_words and (place := wanted.get(start)):
                        line = b" ".join(words)
                        if xxhash.xxh3_128_digest(line) == place["class"]:
                            rows["node"].append(place["node"])
                            rows["words"].append(line)
            yield pa.RecordBatch.from_pydict(rows, schema)

    return run


def _block_links(sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """``(smallest, other)`` for the members that links between the two sides connect."""
    sizes = np.array([len(t) for t in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        alike = 100 * shared >= percent * (sizes.sum() - shared)
        return [(int(nodes.min()), int(nodes.max()))] if alike else []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    matrix = np.zeros((len(sets), int((times > 1).sum())), np.float32)
    matrix[owner[shared], number[column[shared]]] = 1
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    both = matrix[left] @ matrix[right].T
    i, j = np.nonzero((100 + percent) * both >= percent * (sizes[left][:, None] + sizes[right][None, :]))
    parent = {int(n): int(n) for n in nodes}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(nodes[left[i]].tolist(), nodes[right[j]].tolist()):
        p, q = root(x), root(y)
        parent[max(p, q)] = min(p, q)
    return [(root(n), n) for n in parent if root(n) != n]


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of blocks ``band, a, b, side, node, words`` that come one after another."""
        waiting: list[pa.RecordBatch] = []

        def links(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            keys = np.stack([table[c].to_numpy() for c in ("band", "a", "b")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), *([table.num_rows] if last else [])]
            nodes, side, words = table["node"].to_numpy(), table["side"].to_numpy(), table["words"]
            known: dict[int, np.ndarray] = {}
            edges = []
            for start, end in zip(bounds, bounds[1:]):
                sets = []
                for i in range(start, end):
                    if (own := known.get(nodes[i])) is None:
                        own = np.unique(shingle_hashes(word_hashes(words[i].as_py().split(b" "))))
                        known[nodes[i]] = own
                    sets.append(own)
                edges += _block_links(sets, nodes[start:end], side[start:end], percent)
            rest = [] if last else table.slice(bounds[-1]).to_batches()
            src, dst = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"]), rest

        for batch in batches:
            if batch.num_rows:
                found, waiting = links(pa.Table.from_batches([*waiting, batch]), last=False)
                yield found
        if waiting:
            yield links(pa.Table.from_batches(waiting), last=True)[0]

    return run


def _compared(blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links within blocks ``band, a, b, side, node``."""
    blocks = blocks.join(texts, "node").select("band", "a", "b", "side", "node", "words")
    # Blocks are small and many: they are sorted side by side and taken a batch at a time.
    blocks = blocks.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")
    return blocks.mapInArrow(_links(percent), "src long, dst long").distinct()


def _class_links(docs: DataFrame, classes: DataFrame, scratch: Scratch, percent: int, min_words: int) -> DataFrame:
    """Links ``src, dst`` between nodes of ``classes(class, node, place, bands)``."""
    members = classes.select("node", F.explode("bands").alias("band"))
    meets = scratch.write(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "meets")
    members = scratch.write(members.join(meets.select("band"), "band"), "met")
    scratch.drop(meets)
    groups = members.groupBy("band").agg(
        F.count("*").alias("n"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("xor_"), F.sum("node").alias("sum_")
    )
    # Bands in which the same classes meet are compared once.
    groups = groups.groupBy("n", "leader", "xor_", "sum_").agg(F.min("band").alias("band"))
    groups = scratch.write(groups.select("band", "n", "leader"), "bands")
    met, members = members, scratch.write(members.join(groups, "band"), "members")
    scratch.drop(met, groups)
    wanted = members.select("node").distinct().join(classes, "node")
    wanted = wanted.select(F.col("place.doc_id").alias("doc_id"), F.struct(F.col("place.start").alias("start"), "class", "node").alias("line"))
    wanted = scratch.write(wanted.groupBy("doc_id").agg(F.collect_list("line").alias("lines")), "wanted")
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", "lines").mapInArrow(_class_texts(min_words), "node long, words binary")
    texts = scratch.write(texts.groupBy("node").agg(F.first("words").alias("words")), "texts")

    pairs = scratch.write(members.where("node <> leader").select("leader", "node").distinct(), "pairs")
    parts = pairs.groupBy("leader").agg((F.floor(F.count("*") / CHUNK) + 1).alias("parts"))
    parts = scratch.write(parts, "parts")
    others = pairs.join(parts, "leader").select("leader", "node", F.expr("pmod(xxhash64(node), parts)").alias("a"), F.lit(1).alias("side"))
    heads = parts.select("leader", F.col("leader").alias("node"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("a"), F.lit(0).alias("side"))
    stars = heads.unionByName(others)
    stars = stars.select(F.col("leader").alias("band"), "a", F.lit(0).cast("long").alias("b"), "side", "node")
    near = scratch.write(_compared(stars, texts, percent), "stars")
    # Only where a class is not linked with its band's first are the others compared as well.
    linked = near.select(F.col("src").alias("leader"), F.col("dst").alias("node"), F.lit(True).alias("linked"))
    rest = members.where("n > 2 AND node <> leader").join(linked, ["leader", "node"], "left")
    open_ = rest.groupBy("band").agg(F.count("*").alias("n_"), F.count("linked").alias("linked_")).where("linked_ < n_")
    open_ = open_.select("band", F.ceil(F.col("n_") / CHUNK).alias("parts"))
    rest = scratch.write(rest.select("band", "node").join(open_, "band"), "rest")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    dealt = dealt.select(
        "band", "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    links = scratch.write(near.union(_compared(dealt, texts, percent)), "links")
    scratch.drop(members, wanted, texts, pairs, parts, near, rest)
    return links


def _repeated_lines(docs: DataFrame, spots: DataFrame, scratch: Scratch, percent: int, min_words: int) -> DataFrame:
    """``doc_id, start, end, cluster_id, copies, kept``: occurrences of paragraphs that repeat."""
    spots = spots.where("class IS NOT NULL")
    classes = spots.groupBy("class").agg(
        F.first("bands").alias("bands"), F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("place")
    )
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = _class_links(docs, classes, scratch, percent, min_words)
    found = components(links, scratch)
    named = classes.select("class", "node", "n", "place").join(found, "node", "left").where("n > 1 OR component IS NOT NULL")
    named = scratch.write(named.withColumn("of_", F.coalesce("component", "node")), "named")
    scratch.drop(classes, links)
    names = named.groupBy("of_").agg(
        F.hex(F.min("class")).alias("cluster_id"), F.sum("n").alias("copies"), F.min("place").alias("first_")
    )
    names = scratch.write(named.select("class", "of_").join(names.where("copies > 1"), "of_").drop("of_"), "names")
    lines = spots.select("doc_id", "start", "end", "class").join(names, "class")
    kept = F.struct("doc_id", "start") == F.col("first_")
    lines = scratch.write(lines.select("doc_id", "start", "end", "cluster_id", "copies", kept.alias("kept")), "lines")
    scratch.drop(named, names)
    return lines


def _fields(lists: pa.ListArray, i: int) -> list[np.ndarray]:
    """The fields of the structs in row ``i``, none for null."""
    found = lists[i].values
    if found is None:
        return [np.zeros(0, np.int64)] * lists.type.value_type.num_fields
    return [found.field(k).to_numpy() for k in range(found.type.num_fields)]


def _free_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors outside the lines that are not kept, with the words ``low`` to ``high`` around
    them that are free as well."""
    names = ("doc_id", "start", "anchor", "low", "high")
    for batch in batches:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        for i, doc in enumerate(batch.column(0).to_pylist()):
            start, anchor = _fields(batch.column(1), i)
            begins, ends = _fields(batch.column(2), i)
            order = np.argsort(begins, kind="stable")
            begins = np.append(begins[order], np.int64(1 << 62))
            ends = np.insert(np.maximum.accumulate(ends[order]), 0, 0)
            # Of the lines that begin before an anchor's end the last to end is all before it, or hits it.
            before = np.searchsorted(begins, start + RUN_WORDS)
            free = ends[before] <= start
            start, anchor, before = start[free], anchor[free], before[free]
            low = np.maximum(start - REACH, ends[before])
            high = np.minimum(start + RUN_WORDS + REACH, begins[before])
            for column, values in zip(columns, (np.full(len(start), doc, np.int64), start, anchor, low, high)):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=list(names))


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around the anchors of a text, those of the anchor itself included."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "anchor", "low")] + [("words", pa.binary())])
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in schema}
        for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            words = space_words(text.as_py())
            for p in places:
                if p["start"] + RUN_WORDS <= len(words):
                    around = b" ".join(words[p["low"] : p["high"]])
                    for name, value in zip(rows, (doc, p["start"], p["anchor"], p["low"], around)):
                        rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema)


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, start, end, source_doc, source_start`` of anchors whose words are those of
    the first occurrence, widened as far as the words on both sides agree."""
    names = ("doc_id", "start", "end", "source_doc", "source_start")
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in names}
        for doc, start, low, words, source, source_start, source_low, source_words in zip(*(c.to_pylist() for c in batch.columns)):
            one, two = words.split(b" "), source_words.split(b" ")
            i, j = start - low, source_start - source_low
            if one[i : i + RUN_WORDS] != two[j : j + RUN_WORDS]:
                continue
            left = 0
            while left < min(i, j) and one[i - left - 1] == two[j - left - 1]:
                left += 1
            right = RUN_WORDS
            while right < min(len(one) - i, len(two) - j) and one[i + right] == two[j + right]:
                right += 1
            for name, value in zip(names, (doc, start - left, start + right, source, source_start - left)):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in rows.items()})


def _several(rows: DataFrame) -> DataFrame:
    """Anchors that more than one document holds, with their first occurrence."""
    groups = rows.groupBy("anchor").agg(F.min("doc_id").alias("first_"), F.max("doc_id").alias("last_"))
    return groups.where("first_ < last_").select("anchor", F.col("first_").alias("source_doc"))


def _chained(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``rows`` with ``chain_``, which those of a key have in common that overlap one after another."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new_", F.when(reach > F.col(start), 0).otherwise(1))
    return rows.withColumn("chain_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def _passages(docs: DataFrame, spots: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, start, end, cluster_id, copies, kept``: passages inside lines and across them."""
    anchors = spots.where("anchor IS NOT NULL").select("doc_id", "start", "anchor")
    several = scratch.write(_several(anchors).select("anchor"), "several")
    places = anchors.join(several, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("start", "anchor")).alias("places"))
    gone = lines.where("NOT kept").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    free = places.join(gone, "doc_id", "left").select("doc_id", "places", "gone")
    free = free.mapInArrow(_free_anchors, "doc_id long, start long, anchor long, low long, high long")
    free = scratch.write(free, "free")
    scratch.drop(several)
    groups = scratch.write(_several(free), "groups")
    found = free.join(groups, "anchor")
    # Of the first document only the first occurrence is needed: it is the source.
    firsts = found.where("doc_id = source_doc").groupBy("anchor").agg(
        F.min(F.struct("start", "low", "high", "doc_id")).alias("f")
    )
    columns = ["doc_id", "start", "anchor", "low", "high"]
    needed = firsts.select(*[F.col("anchor") if c == "anchor" else F.col(f"f.{c}").alias(c) for c in columns])
    needed = needed.union(found.where("doc_id > source_doc").select(*columns))
    needed = needed.groupBy("doc_id").agg(F.collect_list(F.struct(*columns[1:])).alias("places"))
    needed = scratch.write(needed, "needed")
    around = docs.join(needed, "doc_id").select("doc_id", "text", "places")
    around = scratch.write(around.mapInArrow(_surroundings, "doc_id long, start long, anchor long, low long, words binary"), "around")
    around_all = around.join(groups, "anchor")
    sources = around_all.where("doc_id = source_doc").select(
        "anchor", "source_doc", F.col("start").alias("source_start"), F.col("low").alias("source_low"), F.col("words").alias("source_words")
    )
    copies = around_all.where("doc_id > source_doc").drop("source_doc").join(sources, "anchor")
    copies = copies.select("doc_id", "start", "low", "words", "source_doc", "source_start", "source_low", "source_words")
    wide = copies.mapInArrow(_widened, "doc_id long, start long, end long, source_doc long, source_start long")
    wide = wide.withColumn("shift", F.col("start") - F.col("source_start"))
    keys = ["doc_id", "source_doc", "shift"]
    runs = _chained(wide, keys, "start", "end").groupBy(*keys, "chain_").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.select(
        "doc_id", "start", "end", "source_doc", (F.col("start") - F.col("shift")).alias("source_start"), (F.col("end") - F.col("shift")).alias("source_end")
    )
    runs = scratch.write(runs, "runs")
    scratch.drop(free, groups, needed, around)
    # Each distinct source once: a passage of many copies is one row here.
    span = ["source_doc", "source_start", "source_end"]
    spans = _chained(runs.groupBy(*span).agg(F.count("*").alias("n")), ["source_doc"], "source_start", "source_end")
    spans = scratch.write(spans, "spans")
    kept = spans.groupBy("source_doc", "chain_").agg(
        F.min("source_start").alias("start"), F.max("source_end").alias("end"), (F.sum("n") + 1).alias("copies")
    )
    kept = kept.withColumn("cluster_id", F.concat_ws(":", "source_doc", "start", "end"))
    kept = scratch.write(kept, "kept")
    named = spans.join(kept.select("source_doc", "chain_", "cluster_id", "copies"), ["source_doc", "chain_"])
    copied = runs.join(named, span).select("doc_id", "start", "end", "cluster_id", "copies", F.lit(False).alias("kept"))
    kept = kept.select(F.col("source_doc").alias("doc_id"), "start", "end", "cluster_id", "copies", F.lit(True).alias("kept"))
    return kept.union(copied)


def repeated_passages(docs: DataFrame, percent: int = 75, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, kind, start, end, n_words, cluster_id, copies, kept`` of every passage that
    repeats: ``kind`` is ``paragraph`` or ``segments``; the range counts words of the text,
    end exclusive; ``kept`` marks the one copy of each cluster that stays.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    schema = "doc_id long, start long, end long, class binary, bands array<long>, anchor long"
    spots = scratch.write(docs.mapInArrow(_cut(min_words), schema), "spots")
    lines = _repeated_lines(docs, spots, scratch, percent, min_words)
    inside = _passages(docs, spots, lines, scratch)
    scratch.drop(spots)
    columns = ["doc_id", "kind", "start", "end", "cluster_id", "copies", "kept"]
    found = lines.withColumn("kind", F.lit("paragraph")).select(*columns)
    found = found.union(inside.withColumn("kind", F.lit("segments")).select(*columns))
    return found.withColumn("n_words", F.col("end") - F.col("start"))


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the passages that are not kept; other text, white space included,
    stays, and so do texts without such passages."""
    columns = docs.columns
    docs = docs.drop("cuts_")
    gone = passages.where("NOT kept").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cuts_"))
    rows = docs.join(gone, "doc_id", "left")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, cuts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not cuts or texts[i] is None:
                    continue
                places = [m.span() for m in word.finditer(texts[i])]
                out, done = [], 0
                for cut in sorted((c["start"], c["end"]) for c in cuts):
                    if cut[1] > len(places):
                        continue  # of another row of this doc_id
                    begin, end = places[cut[0]][0], places[cut[1] - 1][1]
                    out.append(texts[i][done : max(done, begin)])
                    done = max(done, end)
                texts[i] = "".join(out) + texts[i][done:]
            arrays = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return rows.mapInArrow(run, rows.drop("cuts_").schema).select(*columns)
