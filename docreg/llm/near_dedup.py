"""Near-duplicates by MinHash bands, odd sketches and a check on full sets.

1. Every text becomes its set of word shingles, MinHash samples of it, and an odd
   sketch: one bit per sample is flipped in a small bitmap. The number of bits in
   which two bitmaps differ estimates how many samples differ.
2. Texts with equal sets are one class; only one member of a class goes on.
3. Classes that share a band of samples are candidates. A band's bucket links its
   members to one center, not to each other. Sketches drop the candidates that are
   too far, full sets confirm the rest, and components are formed. The sketch of the
   samples is judged 5.5 standard deviations above the threshold; a second odd
   sketch, of the whole set, differs in no more bits than the sets in shingles, so
   it only drops pairs that are certainly apart.
4. Buckets that still hold several components are looked through in whole: each
   pair of members of different components is compared by sketch, in blocks of
   bounded size, and what the sketches leave is confirmed on full sets. So no link
   that any band shows is lost, and a large group of copies, which is one component
   by then, costs no pairs.

Rows of one ``doc_id`` are one document, except in ``keep_one``: an id that holds
several texts ties their components. Defined results: a text with fewer words
than a shingle is one shingle; texts without words have an empty set and are linked
with nothing; rows without id are linked with nothing and have no component;
repeated rows are in one component; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.llm.base import as_long, coded_words, mixed, paired, pieces, sent, word_hashes
from docreg.llm.components import components

_PIECE_BYTES = 3_000_000
_U64 = np.uint64
#: Members of a bucket that are compared side by side.
BLOCK = 2_048


@dataclass(frozen=True)
class Plan:
    """``percent``: texts are linked if 100 * common >= percent * all shingles. Bands
    of ``rows`` samples: at the threshold, a pair is missed by all of them with a
    probability of (1 - (percent/100) ** rows) ** bands, below one in a million."""

    words: int = 3
    percent: int = 85
    bands: int = 30
    rows: int = 4
    bits: int = 512
    set_bits: int = 1024

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_apart(self) -> int:
        """Most sketch bits in which linked texts differ. A sample that differs flips
        two bits at most; the number that differ is taken 5.5 standard deviations
        above its mean at the threshold."""
        miss = 1 - self.percent / 100
        return int(np.ceil(2 * (self.samples * miss + 5.5 * np.sqrt(self.samples * miss * (1 - miss)))))


    def may_link(self, n_a, n_b, bits: np.ndarray) -> np.ndarray:
        """Which pairs sizes and sketches leave, from the XOR of their sketches."""
        words = self.bits // 64
        samples = np.bitwise_count(bits[:, :words]).sum(axis=1, dtype=np.int64)
        shingles = np.bitwise_count(bits[:, words:]).sum(axis=1, dtype=np.int64)
        near = 100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b)
        return near & (samples <= self.most_apart()) & ((100 + self.percent) * shingles <= (100 - self.percent) * (n_a + n_b))


def _sets(texts: list[str | None], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's shingle set, and the sets' hashes one after another."""
    counts, codes, words = coded_words(texts)
    own = word_hashes(words)[codes] if len(words) else np.zeros(0, _U64)
    begin = np.cumsum(counts) - counts
    shingles = np.where(counts >= plan.words, counts - plan.words + 1, (counts > 0).astype(np.int64))
    # a text with fewer words is one shingle of all of them
    text = np.repeat(np.arange(len(texts)), shingles)
    start = np.repeat(begin, shingles) + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    end = np.minimum(start + plan.words, (begin + counts)[text])
    h = own[start] if len(own) else own
    for step in range(1, plan.words):
        more = start + step < end
        h[more] = paired(h[more], own[start[more] + step])
    h = paired(h, (end - start).astype(_U64))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(text[new], minlength=len(texts)), h[new]


def _signatures(sizes: np.ndarray, h: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text with a set: two sums that name the set, its bands, its sketch."""
    full = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[full]
    n = len(begin)
    if not n:
        return np.zeros((0, 2), _U64), np.zeros((0, plan.bands), _U64), np.zeros((0, (plan.bits + plan.set_bits) // 64), _U64)
    with np.errstate(over="ignore"):
        names = np.stack([np.add.reduceat(mixed(h ^ _U64(k)), begin) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
        seeds = mixed(np.arange(1, 2 * plan.samples + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
        bands = np.zeros((n, plan.bands), _U64)
        sketch = np.zeros((n, plan.bits // 64), _U64)
        row = np.arange(n)
        for i in range(plan.samples):
            least = np.minimum.reduceat((h ^ seeds[2 * i]) * (seeds[2 * i + 1] | _U64(1)), begin)
            band = i // plan.rows
            bands[:, band] = paired(bands[:, band] + _U64(band + 1), least)
            place = mixed(least + seeds[2 * i]) % _U64(plan.bits)
            sketch[row, (place >> _U64(6)).astype(np.int64)] ^= _U64(1) << (place & _U64(63))
        # parity of the set's own shingles: how often each place of a text is hit, odd or even
        place = (mixed(h) % _U64(plan.set_bits)).astype(np.int64) + np.repeat(np.arange(n), sizes[full]) * plan.set_bits
        odd = (np.bincount(place, minlength=n * plan.set_bits) & 1).astype(np.uint8).reshape(n, -1)
        own = np.packbits(odd, axis=1, bitorder="little").view(np.uint64)
    return names, bands, np.column_stack([sketch, own])


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n_shingles, name, bands, sketch) of every row; the last three are
    null without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE_BYTES):
                sizes, h = _sets(part.column("text").to_pylist(), plan)
                names, bands, sketch = _signatures(sizes, h, plan)
                full = np.flatnonzero(sizes)

                def spread(values: list) -> list:
                    out = [None] * len(sizes)
                    for i, v in zip(full, values):
                        out[i] = v
                    return out

                yield pa.record_batch([
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spread([x.tobytes() for x in names]), pa.binary()),
                    pa.array(spread(list(as_long(bands))), pa.list_(pa.int64())), pa.array(spread([x.tobytes() for x in sketch]), pa.binary()),
                ], names=["doc_id", "n_shingles", "name", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_shingles long, name binary, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, shingles) of every row with words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE_BYTES):
                sizes, h = _sets(part.column("text").to_pylist(), plan)
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(as_long(h), pa.int64()))
                yield pa.record_batch([part.column("doc_id"), found], names=["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, shingles array<long>").where(F.size("shingles") > 0)


@dataclass(frozen=True)
class Texts:
    """The rows, and the ids that several rows have; None if no id has."""

    rows: DataFrame
    repeated: DataFrame | None


def _near(pairs: DataFrame, plan: Plan) -> DataFrame:
    """Of pairs (a, b, n_a, n_b, sketch_a, sketch_b), those that sizes and sketches
    do not rule out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(plan.may_link(n_a, n_b, left ^ right)))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(keep, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, docs: Texts, plan: Plan) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets. Only texts of candidates are
    read again, and each set is built once. Of rows that repeat id and set one goes
    on, so repeats cost no pairs."""
    ids = reliable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = reliable(full_sets(docs.rows.join(sent(ids), "doc_id", "left_semi"), plan))
    if docs.repeated is not None:
        once = sets.join(sent(docs.repeated), "doc_id", "left_semi").distinct()
        sets = reliable(sets.join(sent(docs.repeated), "doc_id", "left_anti").unionByName(once))
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    joint = F.size("set_a") + F.size("set_b") - common
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(common * 100 >= joint * plan.percent).select("a", "b")
    return found if docs.repeated is None else found.distinct()


def _mixed_pairs(members: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of different components within buckets, as far as sketches leave them.
    A bucket is dealt in blocks; each two blocks of it meet in one task."""
    sized = members.join(members.groupBy("bucket").agg(F.count("*").alias("n_members")), "bucket")
    blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    own = sized.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("blocks", blocks)
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n_shingles", "sketch"
    )
    kind = members.schema["id"].dataType.simpleString()

    def compared(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        ids, comp, n = (table[c].to_numpy() for c in ("id", "component", "n_shingles"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        # in order of size, so that a set is compared only with those of like size
        right = right[np.argsort(n[right], kind="stable")]
        sizes = n[right]
        a, b = [], []
        for x in left:
            from_, to = np.searchsorted(sizes, [-(-n[x] * plan.percent // 100), n[x] * 100 // plan.percent + 1])
            near = right[from_:to]
            near = near[(comp[near] != comp[x]) & ((ids[near] > ids[x]) | (i != j))]
            near = near[plan.may_link(n[near], n[x], sketch[near] ^ sketch[x])]
            a.append(np.full(len(near), ids[x]))
            b.append(ids[near])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else ids[:0], table.schema.field("id").type)
        return pa.table({"a": join(a), "b": join(b)})

    pairs = dealt.groupBy("bucket", "i", "j").applyInArrow(compared, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@dataclass(frozen=True)
class Groups:
    """Confirmed links and the component of every id they hold."""

    links: DataFrame
    labels: DataFrame

    def with_(self, pairs: DataFrame, docs: Texts, plan: Plan) -> Groups:
        """Also the links among ``pairs`` that join different components."""
        of = lambda x: self.labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
        apart = F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
        found = reliable(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b"))
        more = found if found.isEmpty() else reliable(_confirmed(found, docs, plan))
        if more.isEmpty():
            return self
        links = self.links.unionByName(more)
        return Groups(links, components(links))


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id), the smallest
    id among the documents that links connect."""
    signed = reliable(signatures(docs, plan))
    named = signed.where(F.col("name").isNotNull() & F.col("doc_id").isNotNull())
    classes = reliable(named.groupBy("name").agg(F.min("doc_id").alias("id")))
    # one row of each class goes on; repeated rows of its id are one
    chosen = named.join(classes, "name").where(F.col("doc_id") == F.col("id"))
    heads = reliable(chosen.dropDuplicates(["name"]).select("id", "n_shingles", "bands", "sketch"))
    often = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.count("name").alias("named"), F.min("name").alias("low"), F.max("name").alias("high"))
    often = reliable(often.where("n > 1"))
    docs = Texts(docs, None if often.isEmpty() else reliable(often.select("doc_id")))
    # an id that holds several texts ties their classes
    tied = named.join(often.where((F.col("low") < F.col("high")) | (F.col("named") < F.col("n"))).select("doc_id"), "doc_id").join(classes, "name")
    tied = tied.where(F.col("id") < F.col("doc_id")).select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    entries = heads.select("id", F.explode("bands").alias("bucket"))
    centers = entries.groupBy("bucket").agg(F.min("id").alias("center"), F.max("id").alias("last")).where(F.col("center") < F.col("last"))
    entries = reliable(entries.join(centers, "bucket").select("bucket", "id", "center"))
    stars = entries.where(F.col("id") > F.col("center")).select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda x: heads.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    stars = reliable(_near(stars.join(side("a"), "a").join(side("b"), "b"), plan))
    # first one link per document, then the links that still join something
    links = _confirmed(reliable(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), docs, plan)
    links = reliable(links if docs.repeated is None else links.unionByName(tied))
    groups = Groups(links, components(links)).with_(stars, docs, plan)
    groups = groups.with_(_mixed_pairs(_still_mixed(entries, heads, groups.labels), plan), docs, plan)
    # every class, its label, and by its name every document
    classes = classes.join(groups.labels, "id", "left").select("name", F.coalesce("component", "id").alias("component_id"))
    if docs.repeated is not None:
        # rows without words go with the other rows of their id
        bare = signed.where(F.col("name").isNull()).select("doc_id", "n_shingles", "name").join(groups.labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        rest = bare.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        signed = signed.where(F.col("name").isNotNull())
    found = signed.join(classes, "name", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    return found if docs.repeated is None else found.unionByName(rest)


def _still_mixed(entries: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    labelled = reliable(entries.select("bucket", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")).select("bucket")
    return reliable(labelled.join(several, "bucket").join(heads.select("id", "n_shingles", "sketch"), "id"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, row): the rows whole, beside a key that tells id and text apart:
    the id where all its rows hold one text, else a hash behind usual ids. So the
    center of a bucket is the smallest id, which a group's buckets share more often
    than a smallest hash. Ids that are no whole numbers are keys as texts."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    own = F.col("doc_id").cast("long" if whole else "string")
    apart = F.xxhash64(own, "text")
    hashed = apart.bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    hashed = hashed if whole else F.concat(F.lit("\U0010ffff"), hashed.cast("string"))
    texts = docs.groupBy(own.alias("several")).agg(F.min(apart).alias("low"), F.max(apart).alias("high"))
    several = reliable(texts.where((F.col("low") < F.col("high")) & F.col("several").isNotNull()).select("several"))
    rows = docs.select(own.alias("doc_id"), F.struct("*").alias("row"), hashed.alias("hashed"))
    if several.isEmpty():
        return rows.select(F.coalesce("doc_id", "hashed").alias("key"), "doc_id", "row")
    marked = rows.join(sent(several), rows["doc_id"] == several["several"], "left")
    return marked.select(F.when(F.col("several").isNull() & F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(F.col("hashed")).alias("key"), "doc_id", "row")


def keep_one(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row of each component of texts, the one with the smallest id, with all its
    columns; of an id's linked texts the one with the smallest hash. Rows are told
    apart by id and text (by a hash of 62 bits where ids do not), so a text that is linked with none
    stays, whatever other rows of its id hold; of rows that repeat both the smallest
    stays. Rows without id are no copies of rows with one, but of each other: one of
    a component stays, and all without words."""
    keyed = _keyed(docs)
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), plan).groupBy(F.col("doc_id").alias("key"))
    found = found.agg(F.min("component_id").alias("component_id"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    ids = keyed.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    no_id = F.col("doc_id").isNull()
    rows = reliable(found.join(ids, "key").select("key", "doc_id", "component_id", "n", no_id.alias("no_id")).where(~(no_id & (F.col("n_shingles") == 0))))
    first = rows.groupBy("component_id", "no_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    copies = reliable(rows.join(first, "key", "left_anti").select("key"))
    repeated = reliable(rows.where(F.col("n") > 1).select("key"))
    kept = keyed.join(sent(copies), "key", "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    # whole repeats go first, they may be very many
    one = kept.join(sent(repeated), "key", "left_semi").select("key", "row").distinct().groupBy("key").agg(F.min("row").alias("row"))
    return kept.join(sent(repeated), "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


def dedup_digest(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    return near_duplicates(docs, plan).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
