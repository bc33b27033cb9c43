"""How far the word use of the sources of a language lies apart: exact sparse counts, group sums, pairs of sources."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import shared_folder, steps, whole, written

ONE = 1_000_000_000  # a share of one, in the whole numbers that shares are counted in
LARGEST_VOCABULARY = 2**31 - 1
BLOCK_TERMS = 4096  # terms that one group of the pair evaluation holds, at most
TILE = 64  # sources of a tile; such a group holds two tiles at most
#: In every document's list: a vocabulary is then never empty. No text yields it.
EVERYWHERE = ""
#: Letters A-Z as a-z, all other ASCII but a-z as a space; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HELD_ENTRIES = 3_000_000  # entries of vectors that a task holds before it sums them, some 70 MB
BUCKET_PLACES = 1 << 15  # places of the vocabulary that are summed together
RESULT = "source string, part string, item string, value long, rank int"
LANGUAGE = -1  # in place of the number of a source
COMPARED = pa.schema([("no", pa.int32()), ("item_no", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])


def terms_of(texts: pa.Array) -> pa.Array:
    """The terms of each text in order, repeats included: runs of letters and non-ASCII characters, A-Z lower-cased."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2][ends[0] : ends[-1]].to_pybytes() if ends[-1] > ends[0] else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(body.translate(LETTERS)))
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(filled)])
    places = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    terms = words.filter(pa.array(filled)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(kept[places], pa.int32()), terms)


def _marked(terms: pa.Array) -> pa.Array:
    """Each list with ``EVERYWHERE`` in front."""
    counts = terms.value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(counts + 1)])
    place = np.zeros(ends[-1], dtype=np.int64)
    place[np.delete(np.arange(ends[-1]), ends[:-1])] = np.arange(1, counts.sum() + 1)
    words = pa.concat_arrays([pa.array([EVERYWHERE]), terms.flatten()]).take(pa.array(place))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)


def _term_lists(docs: DataFrame) -> DataFrame:
    """``lang, source, terms, part`` of each document, written by language; ``part`` is the language as a folder name.

    Every list has ``EVERYWHERE`` in front.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            columns = [step.column("lang"), step.column("source"), _marked(terms_of(step.column("text")))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "terms"])

    schema = "lang string, source string, terms array<string>"
    listed = docs.mapInArrow(run, schema).withColumn("part", F.concat(F.lit("x"), F.hex(F.encode("lang", "utf-8"))))
    path = shared_folder(docs.sparkSession, "terms")
    # a dictionary of terms costs more to build than it saves
    listed.write.options(**{"compression": "lz4", "parquet.enable.dictionary": "false"}).partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(f"{schema}, part string").parquet(path)


class _Sums:
    """Counts by source and place, summed whenever ``HELD_ENTRIES`` more are held."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.summed = 0

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.setdefault(name, len(self.names)) for name in names], dtype=np.int64)

    def add(self, source: np.ndarray, place: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((source, place, count))
        self.held += len(place)
        if self.held > self.summed + HELD_ENTRIES:
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        source, place, count = (np.concatenate(part) for part in zip(*self.parts, strict=True))
        key = source * LARGEST_VOCABULARY + place
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        totals = np.add.reduceat(count[order], starts) if len(key) else count
        self.parts = [(key[starts] // LARGEST_VOCABULARY, key[starts] % LARGEST_VOCABULARY, totals)]
        self.held = self.summed = len(starts)
        return self.parts[0]


def _summed(vectors: DataFrame, terms: int) -> DataFrame:
    """``source, place, count``: the sparse vectors ``source, places, counts``, summed by source.

    A task sums the vectors it reads and deals the sums out by place, in one row for each bucket of places; a bucket
    is then summed by one task, bucket by bucket.
    """
    buckets = max(32, -(-terms // BUCKET_PLACES))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def dealt() -> pa.RecordBatch:
            source, place, count = sums.sums()
            bucket = place % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(part[order].astype(kind)))
                for part, kind in ((source, np.int32), (place, np.int32), (count, np.int64))
            ]
            names = pa.array([list(sums.names)] * buckets, pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(buckets, dtype=np.int32)), names, *lists], names=["bucket", "names", "source", "place", "count"]
            )

        for batch in batches:
            each = batch.column("places").value_lengths().to_numpy()
            place = batch.column("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            count = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sums.add(np.repeat(sums.numbers(batch.column("source").to_pylist()), each), place, count)
            if sums.summed > HELD_ENTRIES:
                yield dealt()
                sums = _Sums()
        if sums.held:
            yield dealt()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(sums: _Sums) -> pa.RecordBatch:
            source, place, count = sums.sums()
            found = pa.DictionaryArray.from_arrays(pa.array(source.astype(np.int32)), pa.array(list(sums.names), pa.string()))
            columns = [found.cast(pa.string()), pa.array(place.astype(np.int32)), pa.array(count)]
            return pa.RecordBatch.from_arrays(columns, names=["source", "place", "count"])

        own, sums = None, _Sums()
        for batch in batches:
            for row in range(batch.num_rows):
                bucket = batch.column("bucket")[row].as_py()
                if bucket != own and sums.parts:
                    yield done(sums)
                    sums = _Sums()
                own = bucket
                number = sums.numbers(batch.column("names")[row].as_py())
                source, place, count = (batch.column(c)[row].values.to_numpy() for c in ("source", "place", "count"))
                sums.add(number[source], place.astype(np.int64), count)
        if sums.parts:
            yield done(sums)

    rows = vectors.mapInArrow(deal, "bucket int, names array<string>, source array<int>, place array<int>, count array<long>")
    met = rows.repartition(min(buckets, 4096), "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(gather, "source string, place int, count long")


def _count(part: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """``source, place, count`` over the kept terms of a language, ``place, term``, and the number of kept terms."""
    spark = part.sparkSession
    counter = CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(least), vocabSize=LARGEST_VOCABULARY)
    # a vocabulary depends on which documents hold a term, not on how often
    model = counter.fit(part.select(F.array_distinct("terms").alias("terms")))
    mark = model.transform(spark.createDataFrame([([EVERYWHERE],)], "terms array<string>")).first().counts
    raw = F.unwrap_udt("counts")
    vectors = model.transform(part.select("source", "terms")).select("source", raw["indices"].alias("places"), raw["values"].alias("counts"))
    counts = written(_summed(vectors, mark.size).filter(F.col("place") != int(mark.indices[0])), "term-counts")
    # the vocabulary as a table: as the model writes it, place by place
    path = shared_folder(spark, "vocabulary")
    model.write().save(path)
    names = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("place", "term"))
    return counts, names, mark.size - 1


def _share(count: str, total: str) -> Column:
    """1 + floor(ONE * (count + 1) / total); in decimals where the product leaves a long."""
    wide = f"cast({ONE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} as decimal(19,0))"
    return F.expr(f"CASE WHEN {count} < {2**63 // ONE - 1} THEN {ONE}L * ({count} + 1) div {total} ELSE {wide} END + 1")


def compare(rows: pa.Table, size: int, top: int) -> pa.Table:
    """What the terms of a block add to the value of each two sources of two tiles of ``size`` sources.

    Rows hold ``no`` (source; ``LANGUAGE`` for the whole language), ``place`` (term; -1 for the share of a term that
    the source lacks), ``share``, and ``terms``, the size of the vocabulary. Where neither source has a term, both have
    their smallest shares; the first block counts that value for the whole vocabulary, and all blocks only what terms
    differ from it. Where a tile meets itself, each source's terms come as well that may be among its ``top`` ones:
    of the block's, the first ones and all that equal the last of them.
    """
    number, place, share = (rows.column(c).to_numpy() for c in ("no", "place", "share"))
    whole_language = number == LANGUAGE
    spoken, usual = place[whole_language], share[whole_language]
    number, place, share = number[~whole_language], place[~whole_language], share[~whole_language]
    sources, column = np.unique(number, return_inverse=True)
    blank = place < 0
    least = np.zeros(len(sources), dtype=np.int64)
    least[column[blank]] = share[blank]
    column, place, share = column[~blank], place[~blank], share[~blank]
    terms, line = np.unique(place, return_inverse=True)
    shares = np.tile(least, (len(terms), 1))
    shares[line, column] = share
    low, high, first = (rows.column(c)[0].as_py() for c in ("low", "high", "first"))
    missing = (rows.column("terms")[0].as_py() if first else 0) - len(terms)
    tile = sources // size
    found = []
    for other, q in enumerate(least.tolist()):
        partners = np.flatnonzero(tile == (high if tile[other] == low else low))
        partners = partners[partners != other]
        theirs = shares[:, [other]]
        value = ((shares[:, partners] - theirs) ** 2 // theirs).sum(axis=0) + missing * ((least[partners] - q) ** 2 // q)
        found.append((sources[partners], np.full(len(partners), sources[other]), np.full(len(partners), -1), value))
    if low == high and len(place):
        order = np.argsort(spoken)
        against = usual[order][np.searchsorted(spoken[order], place)]
        more = share > against
        column, place, value = column[more], place[more], (share[more] - against[more]) ** 2 // against[more]
        order = np.lexsort((-value, column))
        column, place, value = column[order], place[order], value[order]
        begin = np.searchsorted(column, column)
        last = np.minimum(begin + top, np.searchsorted(column, column, side="right")) - 1
        kept = value >= value[last]
        found.append((sources[column[kept]], np.full(int(kept.sum()), -1), place[kept], value[kept]))
    parts = [np.concatenate(part) for part in zip(*found, strict=True)]
    return pa.table([pa.array(part).cast(kind) for part, kind in zip(parts, COMPARED.types, strict=True)], schema=COMPARED)


def _compared(shares: DataFrame, usual: DataFrame, groups: DataFrame, terms: int, sources: int, top: int) -> DataFrame:
    """``compare`` over blocks of terms and pairs of tiles of sources: a row for two sources only after its sums."""
    blocks, tiles = max(1, -(-terms // BLOCK_TERMS)), -(-sources // TILE)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    block = F.pmod("place", F.lit(blocks))
    tile = F.floor(F.col("no") / TILE).cast("int")
    blank = groups.select("no", F.lit(-1).alias("place"), F.col("least").alias("share"), each_block.alias("block"))
    rows = shares.select("no", "place", "share", block.alias("block")).unionByName(blank).withColumn("with", each_tile)
    rows = rows.withColumns({"low": F.least(tile, "with"), "high": F.greatest(tile, "with")}).drop("with")
    spoken = usual.select(F.lit(LANGUAGE).alias("no"), "place", "share", block.alias("block"), each_tile.alias("low"))
    rows = rows.unionByName(spoken.withColumn("high", F.col("low")))
    rows = rows.withColumns({"first": F.col("block") == 0, "terms": F.lit(terms)})
    size = TILE
    return rows.groupBy("block", "low", "high").applyInArrow(
        lambda found: compare(found, size, top), "no int, item_no int, place int, value long"
    )


def _audit_language(part: DataFrame, least_docs: int, top_terms: int) -> DataFrame:
    """``source, part, item, value, rank`` of one language, from its documents' terms."""
    if len(part.select("source").take(least_docs)) == least_docs:
        counts, names, terms = _count(part, least_docs)
    else:  # no term can be kept
        spark, terms = part.sparkSession, 0
        counts = spark.createDataFrame([], "source string, place int, count long")
        names = spark.createDataFrame([], "place int, term string")
    totals = counts.groupBy("source").agg(F.sum("count").alias("total"))
    groups = (
        part.select("source").distinct().join(totals, "source", "left").na.fill(0, ["total"])
        .withColumn("no", F.row_number().over(Window.orderBy("source")) - 1)  # one row a source
        .withColumn("whole", F.greatest(F.lit(1), F.col("total") + terms))
    )
    groups = written(groups.withColumn("least", _share("0", "whole")), "sources")
    size = groups.agg(F.count("*").alias("sources"), F.sum("total").alias("total")).first()
    shares = counts.join(groups, "source").select("no", "place", _share("count", "whole").alias("share"))
    usual = counts.groupBy("place").agg(F.sum("count").alias("count"))
    usual = usual.select("place", _share("count", f"{max(1, size.total + terms)}L").alias("share"))
    compared = written(_compared(shares, usual, groups, terms, size.sources, top_terms), "compared")

    sources = groups.select("no", "source")
    items = groups.select(F.col("no").alias("item_no"), F.col("source").alias("item"))
    pairs = compared.filter("item_no >= 0").groupBy("no", "item_no").agg(F.sum("value").alias("value"))
    pairs = pairs.join(items, "item_no").select(F.lit("pair").alias("part"), "no", "item", "value")
    # names decide between equal values: first all terms that could be among the top ones, then their names
    foremost = Window.partitionBy("no").orderBy(F.desc("value"))
    near = compared.filter("place >= 0").withColumn("near", F.rank().over(foremost)).filter(F.col("near") <= top_terms)
    near = near.join(names, "place").select(F.lit("term").alias("part"), "no", F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("no").orderBy(F.desc("value"), "item")
    top = near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms)
    rows = pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(top)
    return rows.join(sources, "no").select("source", "part", "item", "value", "rank")


def audit_sources(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 3,
    top_terms: int = 200,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others, and by which terms.

    A language keeps the terms that ``least_docs`` of its documents hold. A source's share of a term is
    ``1 + floor(10**9 * (count + 1) / (all counts + kept terms))``, a language's likewise over all of its sources. The
    divergence of share p from q is ``floor((p - q) ** 2 / q)``. Part ``pair`` sums it over all kept terms for each
    other source of the language; part ``term`` lists the ``top_terms`` terms that a source has more of than its
    language. Larger values come first, then smaller items by their UTF-8 bytes.

    Null languages, sources and texts count as empty ones. Repeated rows count as often as they come. A language in
    which no term is kept has pairs of value 0; one with a single source has none. An empty table gives an empty
    result. Other columns are ignored. Languages are audited one after another, so that one vocabulary is held in
    memory at a time, and their rows written to the shared folder.
    """
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    lists = _term_lists(docs.select(*[whole(F.col(f"`{c}`").cast("string")).alias(n) for n, c in named.items()]))
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "divergence")
    schema = f"lang string, {RESULT}"
    spark.createDataFrame([], schema).write.parquet(path)
    for row in lists.select("lang", "part").distinct().orderBy("part").collect():
        found = _audit_language(lists.filter(F.col("part") == row.part), least_docs, top_terms)
        found.select(F.lit(row.lang).alias("lang"), "*").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
