"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

One scan turns every text into the set of its word shingles (64-bit hashes), a SuperMinHash signature and
one key per band. Texts with equal sets become one class. Within a bucket each class is compared with the
bucket's smallest class and with a neighbour in hash order, which links most groups in a number of pairs
linear in the rows. What is still apart in a bucket is then compared on the full sets inside tasks, block by
block, and only links between groups leave a task. A bucket of more than BLOCK rows is not compared as a whole:
its rows meet where they share one of the rarest shingles that a similar set must have (the prefix filter, which loses
no pair: if two sets are similar enough, so many of the rarest shingles of each contain a common one), so texts that
only share what is common in the corpus don't meet. Every link is confirmed on the full sets before it counts.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; with
fewer words than a shingle takes, the whole sequence is one shingle; rows with a null identifier are linked like others,
and rows that repeat an identifier with another text are told apart by their texts; a component is named by its smallest
identifier, null where no row of it has one, so there are no ties; of a component one row stays, with the smallest
identifier (nulls last) and then the smallest text digest, and rows that repeat it in key and text stay with it; very long texts are hashed whole, and
blocks are bounded in hashes as in rows; an empty table gives an empty result; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.bpe import slices
from lodestream.llm.components import components
from lodestream.llm.tables import table, whole_text
from lodestream.llm.workers import tidy
from lodestream.session import cut

#: Signature length is BANDS x ROWS. At a similarity of 0.8 a pair misses every band with probability 3e-5 (at 0.85: 4e-7).
BANDS, ROWS = 20, 4
#: Rows of a bucket that meet in one block; neighbours are taken within parts of this size, too.
BLOCK = 512
#: Hashes of a bucket that meet in one block, about (a single larger set is a part of its own).
BLOCK_HASHES = 1 << 22
#: Columns of the 0/1 matrices that count common hashes (at most BLOCK rows and those that seek, of 4 bytes each).
COLUMNS = 8192

#: Cells of the table that tells rare shingles from common ones; any table gives the same links.
CELLS = 1 << 16

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    while len(_POWERS[0]) < n:
        size = len(_POWERS[0])
        for k, base in ((0, _P), (1, _INVERSE)):
            step = np.uint64(pow(int(base), size, 1 << 64))
            _POWERS[k] = np.concatenate([_POWERS[k], _POWERS[k] * step])
    return _POWERS[0][:n], _POWERS[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, A-Z lowered, and the text that it belongs to."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    raw = _LOWER[joined]
    blank = _BLANK[raw]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lengths)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    start, stop = edge[0::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    hashes = _mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * _P)
    return hashes, np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    rolled = hashes.copy()
    for k in range(1, min(width, len(hashes) + 1)):
        rolled[: len(hashes) - k] = _mix(rolled[: len(hashes) - k] * np.uint64(0x100000001B3) + hashes[k:])
    out, at = [], 0
    for n in count.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            whole = np.uint64(n)
            for h in hashes[at : at + n]:
                whole = _mix(np.array([whole]) * np.uint64(0x100000001B3) + h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def superminhash(sets: list[np.ndarray], length: int) -> np.ndarray:
    """Signatures (rows of length numbers: level and random bits) of non-empty sets.

    In step j each element draws a number in [0, 1) and swaps place j of its own permutation with a later one;
    the slot it lands on keeps the least of number + j. All elements take step j together, and a set takes no
    further step once every slot holds less than j (the early stop).
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slots = np.full(len(sets) * length, np.iinfo(np.uint64).max, np.uint64)
    swaps: list[np.ndarray] = []
    for j in range(length):
        draw = _mix(element + np.uint64((j + 1) * int(_P) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(j) << np.uint64(48)) | (draw >> np.uint64(16))
        place = (np.uint64(j) + _mix(draw) % np.uint64(length - j)).astype(np.int64)
        slot = place.copy()
        for t in range(j - 1, -1, -1):
            slot = np.where(slot == swaps[t], t, slot)
        swaps.append(place)
        at = owner * length + slot
        np.minimum.at(slots, at, value)
        most = slots.reshape(len(sets), length).max(1) >> np.uint64(48)
        going = (most > j)[owner]
        if not going.any():
            break
        if not going.all():
            element, owner, swaps = element[going], owner[going], [s[going] for s in swaps]
    return slots.reshape(len(sets), length)


_SIGNED = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for part in slices(texts, 1 << 20):
                sets = shingle_sets(texts[part], width)
                filled = [i for i, s in enumerate(sets) if len(s)]
                full = superminhash([sets[i] for i in filled], BANDS * ROWS)
                banded = full.reshape(len(filled), BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(filled), BANDS)).copy()
                for r in range(ROWS):
                    keys = _mix(keys * _P + banded[:, :, r])
                bands: list = [None] * len(sets)
                for k, i in enumerate(filled):
                    bands[i] = keys[k].view(np.int64)
                content = [np.array([_mix(s).sum(), _mix(s + _P).sum()], np.uint64).tobytes() for s in sets]
                ids, digests = (batch.column(k).slice(part.start, part.stop - part.start) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, digests, pa.array([len(s) for s in sets], pa.int64()), pa.array(content, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _hashed_sets(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for part in slices(texts, 1 << 20):
                sets = shingle_sets(texts[part], width)
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "hashes"])

    return run


def _groups(batches, keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal leading columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            name = tuple(c[a] for c in columns)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def common_counts(sets: list[np.ndarray], seekers: np.ndarray) -> np.ndarray:
    """How many hashes each of the seekers' sets shares with every set: a product of 0/1 matrices, by columns."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    number = np.cumsum(times > 1) - 1
    column = number[column]
    width = int((times > 1).sum())
    out = np.zeros((len(seekers), len(sets)), np.float32)
    for at in range(0, width, COLUMNS):
        inside = (column >= at) & (column < at + COLUMNS)
        part = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        part[row[inside], column[inside] - at] = 1
        out += part[seekers] @ part.T
    return out.astype(np.int64)


def _linked(percent: int):
    """Blocks (bucket, block, id, component, wanted, hashes) to links between classes that are apart so far.

    wanted rows are compared with all rows of the block on their full sets; each gives one link to every other component.
    """

    def links(group: pa.Table) -> Iterator[tuple[int, int]]:
        ids, component = group.column(2).to_numpy(), group.column(3).to_numpy()
        wanted = group.column(4).to_numpy(zero_copy_only=False).astype(bool)
        hashes = group.column(5).combine_chunks()
        sets = [hashes[i].values.to_numpy() for i in range(len(ids))]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        seekers = np.flatnonzero(wanted)
        if not len(seekers) or (component == component[0]).all():
            return
        common = common_counts(sets, seekers)
        union = sizes[seekers][:, None] + sizes[None, :] - common
        found, other = np.nonzero((100 * common >= percent * union) & (component[seekers][:, None] != component[None, :]))
        seen = set()
        for i, o in zip(seekers[found].tolist(), other.tolist()):
            if (i, component[o]) not in seen:
                seen.add((i, component[o]))
                yield min(ids[i], ids[o]), max(ids[i], ids[o])

    def run(batches):
        for group in _groups(batches, 2):
            found = list(links(group))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _prefixes(counts: np.ndarray, percent: int):
    """Rows (id, component, hashes) to (id, component, n, rare): as many of a set's rarest hashes as a similar set must share one of."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            rare, sizes = [], []
            for i in range(batch.num_rows):
                own = lists[i].values.to_numpy()
                sizes.append(n := len(own))
                rare.append(own[np.lexsort((own, counts[own & (CELLS - 1)]))[: n - (percent * n + 99) // 100 + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], names=["id", "component", "n", "rare"])

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """Of keys (bucket) whose rows are in several components: parts for all rows and for seekers, main (the largest component; seekers are outside of it)."""
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"))
    found = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("rows"), F.sum("hashes").alias("hashes"), F.max(F.struct("size", "component", "hashes")).alias("main")).filter("parts > 1")
    parts = lambda rows, hashes: F.greatest(F.ceil(rows / BLOCK), F.ceil(hashes / BLOCK_HASHES)).cast("int")
    return found.select("bucket", "rows", F.col("main.component").alias("main"), parts(F.col("rows"), F.col("hashes")).alias("rows_of"), parts(F.col("rows") - F.col("main.size"), F.col("hashes") - F.col("main.hashes")).alias("seekers_of"))


def _open_blocks(met: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is still to be compared: blocks (bucket, block) of at most about 2 x BLOCK rows (id, component, wanted, hashes).

    Every two rows that share a bucket, are in different components and can be similar meet in a block.
    """
    named = met.select("bucket", "id", "n").join(grouped.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = cut(_mixed(named))
    left = named.join(open_.filter(F.col("rows") <= BLOCK), "bucket")
    if open_.filter(F.col("rows") > BLOCK).limit(1).count():
        crowd = named.join(open_.filter(F.col("rows") > BLOCK).select("bucket"), "bucket", "left_semi").select("id", "component").distinct()
        crowd = cut(crowd.join(sets, "id").select("id", "component", "hashes"))
        counts = np.zeros(CELLS, np.int64)
        for r in crowd.select(F.explode("hashes").alias("h")).groupBy(F.expr(f"cast(h & {CELLS - 1} as int)").alias("cell")).count().collect():  # at most CELLS rows
            counts[r[0]] = r[1]
        rare = crowd.mapInArrow(tidy(_prefixes(counts, percent)), "id long, component long, n long, rare array<long>")
        sharing = cut(rare.select(F.explode("rare").alias("bucket"), "id", "component", "n"))
        left = left.unionByName(sharing.join(_mixed(sharing), "bucket"))
    left = left.withColumn("wanted", F.col("component") != F.col("main"))
    left = left.withColumn("own", F.pmod(F.xxhash64("id"), F.col("rows_of")).cast("int")).withColumn("seeks", F.pmod(F.xxhash64("id", F.lit(2)), F.col("seekers_of")).cast("int"))
    # block (i, j) holds the i-th part of the rows and the j-th part of those that seek, so its size is bounded
    stands = "transform(sequence(0, seekers_of - 1), j -> named_struct('block', own * seekers_of + j, 'wanted', wanted and j = seeks))"
    comes = "transform(filter(sequence(0, rows_of - 1), i -> wanted and i != own), i -> named_struct('block', i * seekers_of + seeks, 'wanted', true))"
    placed = left.selectExpr("bucket", "id", "component", f"explode(concat({stands}, {comes})) as at").select("bucket", "at.block", "id", "component", "at.wanted")
    return placed.join(sets, "id").select("bucket", "block", "id", "component", "wanted", "hashes").repartition("bucket", "block").sortWithinPartitions("bucket", "block")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a")
    common = F.size(F.array_intersect("left", "right"))
    return both.filter(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("a", "b")


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text and the text's digest, by which rows without an identifier, or with one that others have, are found again."""
    return docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text"), _digest(text).alias("digest"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(whole_text(text), 256))


def _rows(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Per row of docs: id, digest, n, component_id, and first: whether it is the row that stands for its component (rows without words all do)."""
    source = _source(docs, key, text)
    signed = cut(source.select("id", "text", "digest").mapInArrow(tidy(_sign(width)), "id long, digest binary, n long, content binary, bands array<long>"))
    # equal sets are one class, named by its smallest id
    least = F.min(F.struct(F.col("id").isNull(), "id", "digest", "bands"))
    classes = cut(signed.filter("n > 0").groupBy("n", "content").agg(least.alias("first")).select("n", "content", "first.id", "first.digest", "first.bands"))
    unnamed = classes.groupBy("id").agg(F.count("*").alias("times")).filter("times > 1 or id is null").limit(1).count() > 0
    if unnamed:  # an id is missing, or two classes share one: all names are numbers that stand for nothing else
        classes = cut(classes.withColumn("name", F.monotonically_increasing_id()))
    else:
        classes = classes.withColumn("name", F.col("id"))
    bucketed = classes.select(F.col("name").alias("id"), "n", F.explode("bands").alias("bucket"))
    crowded = bucketed.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    met = cut(bucketed.join(crowded, "bucket"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK).cast("long"))
    chain = Window.partitionBy("bucket", "part").orderBy(F.xxhash64("id", F.lit(1)), "id")
    lined = met.withColumn("part", part).withColumn("next", F.lead("id").over(chain))
    near = lined.select(F.explode(F.array(F.struct(F.col("hub").alias("a"), F.col("id").alias("b")), F.struct(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b")))).alias("p")).select("p.*")
    pairs = near.filter("a < b").distinct()
    # whatever else meets in a bucket is one of these, too
    involved = met.select(F.col("id").alias("name")).distinct().join(classes, "name").select("name", F.col("id").alias("of"), F.col("digest").alias("text_of"))
    texts = source.join(involved, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_of"))).select("name", "text")
    sets = cut(texts.mapInArrow(tidy(_hashed_sets(width)), "id long, hashes array<long>").dropDuplicates(["id"]))
    links = cut(_confirm(pairs, sets, percent))
    grouped = components(links)
    dealt = _open_blocks(met, grouped, sets, percent)
    fresh = cut(dealt.mapInArrow(tidy(_linked(percent)), "a long, b long").distinct())
    if fresh.limit(1).count():
        grouped = components(links.unionAll(fresh))
    leaders = classes.join(grouped.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    if unnamed:
        heads = leaders.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest", "name")).alias("head"))
        leaders = leaders.join(heads, "component").withColumn("component_id", F.col("head.id")).withColumn("heads", F.col("name") == F.col("head.name"))
    else:
        leaders = leaders.withColumn("component_id", F.col("component")).withColumn("heads", F.col("name") == F.col("component"))
    leaders = leaders.select("n", "content", "component_id", "heads", F.col("id").alias("of"), F.col("digest").alias("text_of"))
    joined = signed.join(leaders, ["n", "content"], "left")
    first = (F.col("n") == 0) | F.col("heads") & F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("text_of"))
    return joined.select("id", "digest", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), first.alias("first"))


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the smallest reachable key, itself included)."""
    return _rows(docs, key, text, width, percent).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The row of docs that stands for its component, with the columns of docs; rows without words all stay."""
    kept = _rows(docs, key, text, width, percent).filter("first").select(F.col("id").alias("__near_key"), F.col("digest").alias("__near_text")).distinct()
    return docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col("__near_key")) & (_digest(text) == F.col("__near_text")), "left_semi")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, UNNEST(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM words)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM shingles x JOIN shingles y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN sides l ON l.a = r.other),
least AS (SELECT doc_id, MIN(other) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
