"""Exact scalar laws as column expressions: identities, numbers, times, tokens, quality, values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns end in \z: Java's $ also matches before a last line end. Fixed values:
UUID7 = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\z"
U128_MAX = "340282366920938463463374607431768211455"
FLAGS = ("stale", "invalid", "substituted", "overridden", "out_of_service", "communication_failure")
FAMILIES = ("real", "signed", "unsigned", "boolean", "state", "text", "artifact")
NANOS = 1_000_000_000


def uuid_valid(text: Column) -> Column:
    """Canonical lower-case text of a UUID of version 7."""
    return F.coalesce(text.rlike(UUID7), F.lit(False))


def uuid_bytes(text: Column) -> Column:
    return F.when(uuid_valid(text), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def uuid_text(raw: Column) -> Column:
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def canonical_decimal(text: Column) -> Column:
    """An unsigned 128-bit number as its shortest decimal text."""
    digits = text.rlike("^(0|[1-9][0-9]{0,38})\\z")
    return F.coalesce(digits & (F.lpad(text, 39, "0") <= F.lit(U128_MAX)), F.lit(False))


def portable_token(text: Column) -> Column:
    return F.coalesce(text.rlike("^[ -~]{1,256}\\z"), F.lit(False))


def content_format(text: Column) -> Column:
    return F.coalesce(text.rlike("^[!-@\\[-~]{1,64}\\z"), F.lit(False))


def retry_key(text: Column) -> Column:
    return F.coalesce(text.rlike("^[ -~]{1,128}\\z"), F.lit(False))


def exact_text(text: Column) -> Column:
    return F.coalesce(F.char_length(text) <= 4096, F.lit(False))


def declaration_reference(text: Column) -> Column:
    return F.coalesce(F.char_length(text).between(1, 1024) & ~text.rlike("\\p{Cc}"), F.lit(False))


def seconds_of_ms(ms: Column) -> Column:
    """Floor of ms / 1000, also at the smallest long."""
    return F.floor(ms.cast("decimal(20,0)") / 1000).cast("long")


def nanos_of_ms(ms: Column) -> Column:
    return (F.pmod(ms, F.lit(1000)) * 1_000_000).cast("int")


def ms_of_time(s: Column, n: Column) -> tuple[Column, Column]:
    """Milliseconds and refusal: below a millisecond first, then overflow."""
    exact = s.cast("decimal(25,0)") * 1000 + (n / F.lit(1_000_000)).cast("int")
    fits = exact.between(F.lit(-(2**63)).cast("decimal(25,0)"), F.lit(2**63 - 1).cast("decimal(25,0)"))
    refusal = F.when(n % 1_000_000 != 0, "sub_millisecond").when(~fits, "overflow")
    return F.when(refusal.isNull(), exact.cast("long")), refusal


def time_valid(n: Column) -> Column:
    return F.coalesce((n >= 0) & (n < NANOS), F.lit(False))


def flag(flags: Column, name: str) -> Column:
    return F.getbit(flags, F.lit(FLAGS.index(name))) == 1


def with_flag(flags: Column, name: str, on: bool = True) -> Column:
    bit = 1 << FLAGS.index(name)
    return flags.bitwiseOR(F.lit(bit)) if on else flags.bitwiseAND(F.lit(~bit))


def admits(family: Column, kind: Column) -> Column:
    return (kind == family) | (kind == "unavailable")


def real_bits(value: Column) -> Column:
    """The bit pattern of a double as a long, NaN payloads kept; null stays null."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(value, F.lit(0.0)))
    return F.when(value.isNotNull(), bits.cast("long"))


def real_order(bits: Column) -> Column:
    """Orders bit patterns of doubles as unsigned numbers."""
    return bits.bitwiseXOR(F.lit(-(2**63)))


def nonzero(n: Column) -> Column:
    """A schema version or revision: null where it is zero."""
    return F.when(n != 0, n)
