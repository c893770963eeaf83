"""Sharding by a keyed permutation of global row numbers, in DataFrame functions only.

Rows get numbers 0..N-1 in the order of (row hash, id, size): the hash is spread evenly, so fixed ranges of
it are buckets of nearly equal size however ids, texts or sources are skewed. A bucket's number range
begins where the counts of the buckets before it end (a table of at most 16 ** DIGITS rows), and inside a bucket a
window numbers the rows. A Feistel network over Z_a x Z_b with a*b >= N permutes the numbers; a value that
leaves 0..N-1 walks along its cycle until it is inside. Then shard = p mod k and slot = p div k, so any
reader computes a row's place from its number, and shards differ by one row at most.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a hash range that is numbered on its own, about; hexadecimal digits by which ranges are told, at most:
#: 16 ** DIGITS rows is the bound of the table of offsets.
BUCKET_ROWS, DIGITS = 256, 5
#: Prime modulus of the round function; products of two residues stay below 2^62.
PRIME = 2147483647
ROUNDS = 6
#: Steps a cycle walk may take. At most a-1 values are outside 0..N-1, so no walk is longer where a <= 64;
#: for larger N a step stays outside with a chance below 1/64, and 64 in a row below 2^-384.
WALK = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    raw = hashlib.sha256(f"shards:{seed}".encode()).digest() + hashlib.sha256(f"more:{seed}".encode()).digest()
    word = [int.from_bytes(raw[4 * i : 4 * i + 4], "big") % (PRIME - 1) + 1 for i in range(2 * ROUNDS)]
    return list(zip(word[::2], word[1::2], strict=True))


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_int(x: int, n: int, seed: int) -> int:
    """The permutation for one number, in plain integers: what computes a shard and slot outside Spark."""
    a, b = sides(n)
    keys = round_keys(seed)
    while True:
        left, right = divmod(x, b)
        for k, (m, c) in enumerate(keys):
            t = ((right if k % 2 == 0 else left) * m + c) % PRIME
            t = (t * t + m) % PRIME
            if k % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        x = left * b + right
        if x < n:
            return x


def _once(x: Column, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    """One pass of the network over a lambda's variable: the rounds folded over an array of their keys."""
    big = lambda v: F.lit(v).cast("long")
    rounds = F.array(*[F.struct(big(m).alias("m"), big(c).alias("c"), F.lit(k % 2 == 0).alias("even")) for k, (m, c) in enumerate(keys)])
    start = F.struct(F.call_function("div", x, big(b)).alias("l"), (x % big(b)).alias("r"))

    def merge(s: Column, key: Column) -> Column:
        t = (F.when(key["even"], s["r"]).otherwise(s["l"]) * key["m"] + key["c"]) % big(PRIME)
        t = (t * t + key["m"]) % big(PRIME)
        left = F.when(key["even"], (s["l"] + t) % big(a)).otherwise(s["l"])
        return F.struct(left.alias("l"), F.when(key["even"], s["r"]).otherwise((s["r"] + t) % big(b)).alias("r"))

    return F.aggregate(rounds, start, merge, lambda s: s["l"] * big(b) + s["r"])


def with_permutation(df: DataFrame, number: str, n: int, seed: int, out: str) -> DataFrame:
    """Adds the permuted number as a column: rounds as plain projections, then the walk for rows outside."""
    a, b = sides(n)
    keys = round_keys(seed)
    big = lambda v: F.lit(v).cast("long")
    left, right = f"{out}__l", f"{out}__r"
    df = df.withColumns({left: F.expr(f"`{number}` div {b}L"), right: F.col(number) % big(b)})
    for k, (m, c) in enumerate(keys):
        side = F.col(right if k % 2 == 0 else left)
        df = df.withColumn(f"{out}__t", (side * big(m) + big(c)) % big(PRIME))
        t = (F.col(f"{out}__t") * F.col(f"{out}__t") + big(m)) % big(PRIME)
        df = df.withColumn(left, (F.col(left) + t) % big(a)) if k % 2 == 0 else df.withColumn(right, (F.col(right) + t) % big(b))
    df = df.withColumn(out, F.col(left) * big(b) + F.col(right)).drop(left, right, f"{out}__t")
    if a * b == n:
        return df
    step = lambda x, _: F.when(x < big(n), x).otherwise(_once(x, a, b, keys))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(out), step)
    inside = F.when(walked < big(n), walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    return df.withColumn(out, F.when(F.col(out) < big(n), F.col(out)).otherwise(inside))


def digits_for(n: int) -> int:
    """Leading digits of the hash whose ranges hold about BUCKET_ROWS rows."""
    digits = 1
    while digits < DIGITS and n > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def row_numbers(df: DataFrame, order: list[str], key: str, out: str, n: int) -> DataFrame:
    """Adds gapless numbers from 0 to its n rows in the order of (key, *order), key being a lower-case hex digest.

    Null digests do not occur (callers hash a text that is never null). Rows equal in key and order are
    interchangeable. Costs one aggregation to at most 16 ** DIGITS rows and one exchange by bucket."""
    bucket, before = f"{out}__b", f"{out}__before"
    df = df.withColumn(bucket, F.conv(F.substring(key, 1, digits_for(n)), 16, 10).cast("int"))
    counts = df.groupBy(bucket).agg(F.count("*").alias(before))
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(bucket, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(key, *order))
    # at most 16 ** DIGITS rows of two numbers: a proven bound for the broadcast
    return df.join(F.broadcast(offsets), bucket).withColumn(out, F.col(before) + inside - 1).drop(bucket, before)


def shard(df: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df, then size, text_crc32, shard, slot: law `rows`, counts at most one apart.

    size is the UTF-8 bytes of the text plus 1 (null: 1), text_crc32 the CRC-32 of those bytes (null: 0).
    Null ids sort first among equal hashes; equal rows take any of their numbers. An empty table stays
    empty. Columns of df that are named like an added one are replaced.
    """
    added = ("size", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit(":"), F.md5(text)))
    base = df.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text), "__key": key})
    n = df.count()
    numbered = row_numbers(base, [id_col, "size", "text_crc32"], "__key", "__n", n)
    placed = with_permutation(numbered, "__n", n, seed, "__p")
    k = F.lit(shards).cast("long")
    return placed.withColumns({"shard": (F.col("__p") % k).cast("int"), "slot": F.expr(f"__p div {shards}L")}).select(
        *[c for c in df.columns if c not in added], *added)


#: Production parameters of the query.
SHARDS, SEED = 8, 0


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = shard(docs, SHARDS, SEED)
    return size.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sql() -> str:
    """Independent SQL: a row number over the whole table, the network as unrolled columns, a recursive walk."""
    steps, last = [], "s0"
    for k, (m, c) in enumerate(round_keys(SEED)):
        side = "r" if k % 2 == 0 else "l"
        t = f"((({side} * {m} + {c}) % {PRIME}) * (({side} * {m} + {c}) % {PRIME}) + {m}) % {PRIME}"
        new = f"(l + {t}) % a as l, r" if k % 2 == 0 else f"l, (r + {t}) % b as r"
        steps.append(f"s{k + 1} as (select start, step, a, b, n, {new} from {last})")
        last = f"s{k + 1}"
    chain = ", ".join(steps)
    return f"""
with recursive tbl as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, [1,2,3,4,5,6,7,8]::bigint[]),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v
    from (select unnest(range(256))::bigint as i))),
raw as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, text, strlen(text)::bigint + 1 as size,
        list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint) as bs from raw),
c as (select doc_id, text, size, xor(list_reduce(list_prepend(4294967295::bigint, bs),
        lambda p, q: xor(p >> 8, t[(xor(p, q) & 255) + 1])), 4294967295::bigint) as text_crc32 from b, tbl),
num as (select *, row_number() over (order by md5(coalesce(doc_id::varchar, '-') || ':' || md5(text)),
        doc_id nulls first, size, text_crc32) - 1 as rn from c),
dims as (select n, a, greatest(1, (n + a - 1) // a)::bigint as b from (
  select n, case when n <= 1 then 1 else
    (select max(q) + 1 from range(0, 100000) r(q) where q * q <= n - 1) end::bigint as a from (select count(*)::bigint as n from c))),
walk as (
  select x as start, x, 0 as step, n, a, b from (select unnest(range(0, n)) as x, n, a, b from dims)
  union all
  select start, l * b + r, step + 1, n, a, b from (
    with s0 as (select start, step, a, b, n, x // b as l, x % b as r from walk where step = 0 or x >= n), {chain}
    select * from {last})
),
perm as (select start, x as p from walk where step > 0 and x < n)
select doc_id, size, text_crc32, 'rows' as law, (p % {SHARDS})::integer as shard, p // {SHARDS} as slot,
  null::integer as grown_shard from num join perm on rn = start
"""
