"""Identifiers, payload bits and other scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def hex_value(digits: Column) -> Column:
    """The number that hexadecimal digits name."""
    return F.conv(digits, 16, 10).cast("long")


def canonical_can_id(raw: Column) -> Column:
    """An id as three or more upper-case hex digits: blanks and 0x dropped, leading zeros too; XXX stays."""
    s = F.upper(F.trim(raw.cast("string")))
    s = F.regexp_replace(s, "^0X", "")
    return F.when(s == "XXX", s).otherwise(F.format_string("%03X", hex_value(s)))


def canonical_can_id_of_number(number: Column) -> Column:
    return F.format_string("%03X", number.cast("long"))


def normalize_can_id(raw: Column) -> Column:
    """An id as upper-case hex digits, zero-filled to three but not cut: more leading zeros stay; NULL if not hex."""
    s = F.regexp_replace(F.upper(F.trim(raw.cast("string"))), "^0X", "")
    return F.when(~s.rlike("^[0-9A-F]+$"), F.lit(None).cast("string")).when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def window_id(capture_id: Column, index: Column) -> Column:
    return F.format_string("%s_w%04d", capture_id, index)


def mask_match(payload: Column, mask: Column) -> Column:
    """Whether a payload fits a mask of nibbles, of which X is any; lengths must be equal."""
    pattern = F.concat(F.lit("^"), F.replace(F.upper(mask), F.lit("X"), F.lit(".")), F.lit("$"))
    return F.rlike(F.upper(payload), pattern) & (F.length(payload) == F.length(mask))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; NULL if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def surprise(constant: Column, seen: Column) -> Column:
    """How unexpected it is that a field holds still, given in how many of its windows it did."""
    return -F.log((constant + 1) / (seen + 2))


def bit_positions(start: int, width: int, intel: bool) -> list[int]:
    """A signal's bits, most significant first. Bit n is bit n % 8 of byte n // 8.

    Little-endian (intel) signals run down from their last bit to start; big-endian ones begin at start, run down
    inside a byte, and go on at bit 7 of the next one.
    """
    if intel:
        return [start + width - 1 - k for k in range(width)]
    # Counted from the front, as a big-endian signal runs, bit n has place n ^ 7, and so the other way round.
    return [((start ^ 7) + k) ^ 7 for k in range(width)]


def decode_bits(payload: Column, bits: Column, signed: Column) -> Column:
    """The number in the given bits of a payload, as a double; NaN if one of them is beyond its end.

    Exact in DECIMAL, so that 64 bits fit.
    """
    def one(b: Column) -> Column:
        return F.call_function("shiftright", hex_value(F.substring(payload, (F.floor(b / 8) * 2 + 1).cast("int"), F.lit(2))), (b % 8).cast("int")) % 2

    wide = "decimal(20,0)"
    value = F.aggregate(bits, F.lit(0).cast(wide), lambda acc, b: (acc * 2 + one(b)).cast(wide))
    span = F.aggregate(bits, F.lit(1).cast("decimal(21,0)"), lambda acc, b: (acc * 2).cast("decimal(21,0)"))
    top = one(F.element_at(bits, 1))
    whole = F.array_max(bits) < F.length(payload) * 4
    return F.when(~whole, F.lit(float("nan"))).when(signed & (top == 1), (value - span).cast("double")).otherwise(value.cast("double"))


def drive_clock(window: Column) -> Column:
    """HH:MM:SS at the end of window n of one second, from the number in its id."""
    s = F.regexp_extract(window, r"_w(\d+)$", 1).cast("long") + 1
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def _first(text: Column, regex: str) -> Column:
    """What the group of a regular expression matches first; NULL if nothing."""
    found = F.regexp_extract(text, regex, 1)
    return F.when(found != "", found)


def parse_evidence(evidence: Column) -> Column:
    """struct(stage, can_id, check) from a scorer's text; NULL where it names none.

    The stage stands in brackets in front, the check in parentheses; an id follows ID or, failing that, e.g.
    """
    text = F.coalesce(evidence, F.lit(""))
    stage = F.concat(F.lit("Stage "), _first(text, r"(?i)\A\[stage ([12])\]"))
    can_id = F.coalesce(*[_first(text, rf"(?<!\w){word}\s+(\p{{XDigit}}{{2,3}})(?!\w)") for word in ("ID", r"e\.g\.")])
    return F.struct(stage.alias("stage"), F.upper(can_id).alias("can_id"), _first(text, r"\(([_a-z]+)\)").alias("check"))


def parse_probability(text: Column) -> Column:
    """struct(probability, reason) from a language model's answer.

    From the first {...} if it is JSON: attack_probability (0.5 without one) clamped to 0..1 and the reason. Else the
    first number in the text, or 0.5 if there is none or it is beyond 1, and the text's first 200 characters.
    """
    begin = F.instr(text, "{")
    end = F.call_function("locate", F.lit("}"), text, begin)
    body = F.when((begin > 0) & (end > 0), F.substring(text, begin, end - begin + 1)).otherwise("")
    parsed = F.from_json(body, "attack_probability string, reason string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    given = F.coalesce(parsed["attack_probability"], F.lit("0.5")).try_cast("double")
    reason = F.trim(F.coalesce(parsed["reason"], F.lit("")))
    answered = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)).alias("probability"), F.when(reason == "", "no reason was stated").otherwise(reason).alias("reason"))
    number = _first(text, r"([0-9]*\.?[0-9]+)").try_cast("double")
    shown = F.left(F.translate(F.trim(text), "\n", " "), F.lit(200))
    guessed = F.struct(F.when(number <= 1, number).otherwise(0.5).alias("probability"), F.when(shown == "", "the answer was empty").otherwise(shown).alias("reason"))
    return F.when((body != "") & parsed["_bad"].isNull() & given.isNotNull(), answered).otherwise(guessed)


def binomial_upper_95(k: int, n: int) -> float:
    """The exact one-sided 95 % upper bound (Clopper-Pearson) of a rate of which k of n were seen; 1 if it can't be told.

    It is the p at which at most k of n have a chance of 5 %. The logarithm of that chance is concave in p and falls, so
    Newton's steps from beyond the root come down to it without passing it.
    """
    if n <= 0 or k >= n:
        return 1.0
    ways = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def excess(p: float) -> tuple[float, float]:
        """log(chance / 0.05) and its slope."""
        odds, term, total = (1 - p) / p, 1.0, 1.0
        for i in range(k, 0, -1):  # each term from the one above it
            term *= i / (n - i + 1) * odds
            total += term
        return ways + k * math.log(p) + (n - k) * math.log1p(-p) + math.log(total * 20), -(n - k) / (1 - p) / total

    p = (k + 1) / (n + 1)
    while excess(p)[0] > 0:
        p = (1 + p) / 2
    for _ in range(200):
        value, slope = excess(p)
        if value / slope <= p * 1e-13:
            break
        p -= value / slope
    return p
