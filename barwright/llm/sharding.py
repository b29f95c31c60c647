"""Shards that all hold the mixture of the whole table: proportional stratified interleaving, in DataFrame functions only.

Rows of each source are ranked in a seeded shuffled order. A row's place in the whole is its fractional rank: the i-th of n
rows stands at (i + u) / n, where u, between 0 and 1, is drawn once for each source, so that sources of few rows do not all
stand in the middle. Rows sorted by that fraction carry the mixture in any stretch of them: of every source a stretch that
spans a share x of the fractions has n * x rows, give or take one. The order is cut into shards whose counts differ by one row at
most; the fractions that a shard spans differ from an equal share by about the root of the number of sources over the number of rows.

Neither ranking nor sorting puts a source, or the table, into one task. The shuffled order is by a hash, so its range is cut
into equal parts of about the same number of rows: ranks are counted in a part of a source, after the counts of the
parts before it. Fractions are spread evenly by their making, so their range is cut in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.store import fresh

#: Bits of the hashes that shuffle rows.
BITS = 60
#: Rows that a part of the order has, more or less; there are PARTS_A_TASK parts for each shuffle partition at least, so that they are dealt out evenly.
ROWS_A_PART = 100_000
PARTS_A_TASK = 4


def hashed(value: Column) -> Column:
    """BITS bits of a hash of a string, as a long; null's is that of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def parts_for(rows: int, partitions: int) -> int:
    """The bits by which parts of the order are told apart."""
    return max(1, (max(-(-rows // ROWS_A_PART), PARTS_A_TASK * partitions) - 1).bit_length())


def interleaved(docs: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", ties: Sequence[str] = (), seed: str = "0") -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (0, 1, ... in its shard), both by proportional interleaving of sources.

    The shuffled order goes by a hash of seed and key, then key, then the columns in ties; rows that are equal in all of them
    (repeated rows) may change places with each other. Null sources are a source of their own, as is the empty one; a null
    key is a key. Texts play no part, so null, empty and very long ones are like others. With fewer rows than shards some
    shards are empty; an empty table gives no rows. Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    rows, spark = docs.count(), docs.sparkSession
    bits = parts_for(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s, h, part, start, total, at, place = (fresh(docs, f"_{c}") for c in ("source", "hash", "part", "start", "total", "at", "place"))
    col = lambda c: F.col(f"`{c}`")
    # null and the empty source are told apart, and joins need no nulls
    keyed = docs.withColumns({s: F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("")), h: hashed(F.concat(F.lit(f"{seed}:"), F.coalesce(col(key).cast("string"), F.lit(""))))})
    keyed = keyed.withColumn(part, F.shiftright(h, BITS - bits))
    by_source = Window.partitionBy(s)
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keyed.groupBy(s, part).agg(F.count("*").alias("n"))
    starts = starts.select(s, part, before(by_source.orderBy(part), "n").alias(start), F.sum("n").over(by_source).alias(total))

    def ranked(order: list[Column]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(s, part).orderBy(*order)) - 1 + F.col(start)
        first = hashed(F.concat(F.lit(f"{seed}:"), F.col(s))) / F.lit(float(1 << BITS))
        # rounding could carry the last rank to 1
        out = keyed.join(starts, [s, part]).withColumn(at, (rank + first) / F.col(total))
        return out.withColumn(place, F.least((F.col(at) * (1 << bits)).cast("long"), F.lit((1 << bits) - 1))).drop(part, start, total)

    # which of equal hashes comes first does not change how many rows a part has, so this reads key and source only
    parts = ranked([F.col(h)]).groupBy(place).agg(F.count("*").alias("n"))
    parts = parts.select(place, before(Window.orderBy(place), "n").alias(start))
    order = [F.col(h), *[F.asc_nulls_first(f"`{c}`") for c in (key, *ties)]]
    placed = ranked(order).join(parts, place)
    position = F.row_number().over(Window.partitionBy(place).orderBy(at, s, *order)) - 1 + F.col(start)
    placed = placed.withColumn(at, position).withColumn("shard", F.expr(f"CAST(`{at}` * {shards} DIV {max(rows, 1)} AS INT)"))
    first = F.expr(f"(shard * CAST({rows} AS BIGINT) + {shards - 1}) DIV {shards}")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], "shard", (F.col(at) - first).alias("slot"))


def written_shards(placed: DataFrame, path: str) -> None:
    """Writes rows as one folder a shard (Parquet), each file a stretch of its slots in order; a shard may be written by many tasks."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents. No text is shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleaved(small, shards, ties=["source", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A table of CRC-32's steps by byte, and the sum over a blob as unsigned bigint (DuckDB).
CRC_TABLE = "(SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS steps FROM range(256) AS r(n))"


def crc_sql(text: str, steps: str = "steps") -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB, given a table of steps."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: xor(c >> 8, {steps}[xor(c & 255, b) + 1])))"


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
ORACLE_SQL = f"""
WITH crc AS {CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || source, '') AS s, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, {_HASH.format("'0:' || coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 + {_HASH.format("'0:' || s")} / {float(1 << BITS)}::DOUBLE) / count(*) OVER (PARTITION BY s) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 16 // n)::INT AS shard, row_number() OVER (PARTITION BY pos * 16 // n ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""
