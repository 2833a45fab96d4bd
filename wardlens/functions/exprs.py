"""Column expressions shared by the operators.

Everything here is a built-in Catalyst expression tree, so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's definitions.
LOS_CAP_MIDNIGHTS = 365          # outlier truncation of length of stay
DIGEST_MODULUS = 1_000_000_007   # per-row digest modulus of the table fingerprint
RESULT_ROW_CAP = 10_000          # largest result a query may materialise
SAMPLE_ROWS = 5                  # rows shown with a result or a table profile
TOPK_MAX = 20                    # largest k of a lookup
RRF_K = 60                       # reciprocal-rank-fusion constant
HYBRID_CANDIDATES = 50           # candidates per strategy before fusion
CHUNK_TOKENS, CHUNK_OVERLAP = 512, 64


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def midnights(start, stop) -> Column:
    """Calendar-day boundaries crossed between start and stop (23:00 -> 07:00 is 1)."""
    return F.datediff(F.to_date(col_(stop)), F.to_date(col_(start)))


def los_capped(start, stop, cap: int = LOS_CAP_MIDNIGHTS) -> Column:
    return F.least(midnights(start, stop), F.lit(cap))


def elapsed_hours(start, stop) -> Column:
    """Elapsed clock time in hours (not hour boundaries crossed)."""
    micros = (F.unix_micros(col_(stop).cast("timestamp"))
              - F.unix_micros(col_(start).cast("timestamp")))
    return micros.cast("double") / F.lit(3_600_000_000.0)


def normalise_name(c) -> Column:
    """Payer / organisation name key: spaces trimmed, upper case."""
    return F.upper(F.trim(col_(c)))


def md5_mod(text, modulus: int = DIGEST_MODULUS) -> Column:
    return md5_hex_mod(F.md5(col_(text)), modulus)


def md5_hex_mod(hexs: Column, modulus: int = DIGEST_MODULUS) -> Column:
    """``md5`` digest read as a little-endian 128-bit integer, modulo ``modulus``.

    The digest is split into four little-endian 32-bit words w0..w3 (value =
    w0 + w1*2^32 + w2*2^64 + w3*2^96) and folded with Horner's rule on
    ``2^32 mod modulus``; every intermediate stays below 2^61, so plain bigint
    arithmetic inside whole-stage codegen is exact.  ``hexs`` is the md5 hex digest.
    """

    def byte(i: int) -> Column:
        return F.substring(hexs, 2 * i + 1, 2)

    def word(j: int) -> Column:
        le = F.concat(byte(4 * j + 3), byte(4 * j + 2), byte(4 * j + 1), byte(4 * j))
        return F.conv(le, 16, 10).cast("bigint")

    r = (1 << 32) % modulus
    m = F.lit(modulus).cast("bigint")
    acc = word(3) % m
    for j in (2, 1, 0):
        acc = (acc * F.lit(r).cast("bigint") + word(j)) % m
    return acc


def exact_double(x: Column) -> Column:
    """A double without loss, as its 53-bit whole number and power of two; zero of
    either sign is 0, and what is not finite has its name."""
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("double")
    part = size / F.pow(F.lit(2.0), guess)                      # exact; 1 <= part < 2 but for rounding of log2
    exponent = F.when(part >= 2, guess + 1).when(part < 1, guess - 1).otherwise(guess)
    part = F.when(part >= 2, part / 2).when(part < 1, part * 2).otherwise(part)
    text = F.concat(F.when(x < 0, "-").otherwise(""), (part * float(1 << 52)).try_cast("bigint").cast("string"), F.lit("p"),
                    exponent.try_cast("int").cast("string"))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).when(x == 0, "0").otherwise(text)


def canonical_field(c: Column, dtype: str) -> Column:
    """One field rendered engine-independently, length-prefixed, NULL distinct from text."""
    if dtype in ("double", "float"):
        s = exact_double(c.cast("double"))
    elif dtype.startswith("timestamp"):
        s = F.unix_micros(c.cast("timestamp")).cast("string")      # wall clock, session zone UTC
    elif dtype == "date":
        s = F.unix_date(c).cast("string")
    elif dtype.startswith("array"):
        s = F.array_join(F.transform(c, lambda x: exact_double(x.cast("double"))), ",")
    else:
        s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def canonical_row(df) -> Column:
    """Canonical text of a whole row (all columns in schema order)."""
    return F.concat_ws("|", *[canonical_field(F.col(f"`{f.name}`"), f.dataType.simpleString())
                              for f in df.schema.fields])


def hash_order_key(id_col, seed) -> Column:
    """Engine-independent repeatable ordering key for exact-size samples."""
    return F.md5(F.concat(col_(id_col).cast("string"), F.lit("|"), F.lit(str(seed))))


def ascii_escaped(text) -> Column:
    """Characters outside ASCII as ``\\uXXXX``, those beyond 16 bits as two."""
    c = col_(text)

    def escaped(ch: Column) -> Column:
        code = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        two = F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(""))
        return F.when(ch.rlike("^[\\x00-\\x7F]$"), ch).otherwise(two)

    whole = lambda t: F.when(t.rlike("^[\\x00-\\x7F]*$"), t).otherwise(F.array_join(F.transform(F.split(t, ""), escaped), ""))
    return F.transform(F.array(c), whole)[0]             # a bound name, so that ``text`` is computed once


def canonical_json(text) -> Column:
    """JSON text in one form: keys of all objects in order, no blanks, ASCII only; null if
    it is no JSON or an object repeats a key.  A VARIANT keeps the keys of an object
    sorted, nested ones too, so it is the normal form.  Numbers equal as decimals are
    equal (1.0 is 1)."""
    return ascii_escaped(F.to_json(F.try_parse_json(col_(text))))


def args_hash(text) -> Column:
    """16 hex characters that identify a call's arguments whatever the order of their
    keys; text that is no JSON is taken as it stands."""
    return F.substring(F.sha2(F.coalesce(canonical_json(text), col_(text)), 256), 1, 16)


VERSION_SEPARATOR = "+content."


def recipe_of(version) -> Column:
    """The recipe of a stamped version: what stands before the last separator, or all."""
    cut = F.regexp_extract(col_(version), "(?s)^(.*)" + re.escape(VERSION_SEPARATOR), 1)
    return F.when(F.contains(col_(version), F.lit(VERSION_SEPARATOR)), cut).otherwise(col_(version))


def token_estimate(text) -> Column:
    """Rough token count: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(col_(text)) / 4)).cast("bigint")


def day_bucket(ts, width_days: int) -> Column:
    """Bucket of a timestamp's calendar day, ``width_days`` days wide."""
    return F.floor(F.unix_date(F.to_date(col_(ts))) / F.lit(width_days)).cast("bigint")


def window_buckets(lo_ts, days: int, width_days: int) -> Column:
    """Every day bucket a window ``[lo, lo + days]`` touches (at most two when the
    bucket width equals the window): exploded on the probing side of a range join,
    so the equi-key becomes (entity, bucket) and only stays near in time meet."""
    lo = F.unix_date(F.to_date(col_(lo_ts)))
    return F.sequence(F.floor(lo / F.lit(width_days)).cast("bigint"),
                      F.floor((lo + F.lit(days)) / F.lit(width_days)).cast("bigint"))
