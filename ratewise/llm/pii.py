"""Operator 5: personal data by patterns, checksums and context.

Regular expressions propose spans, validators (Luhn, mod-97, part and digit
counts) confirm or drop them, and context words near a span raise its score.
The four base kinds stand on their own; the added kinds count only when score
and context make them likely.

Only Column expressions run here: one scan, no shuffle.  A text that lacks the
characters of a kind is not matched against its pattern.  Every pattern is
possessive and anchored so that matching is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL_CHARS = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern   proposes; ``guard`` is a cheaper pattern or literal that every
              text with a match holds
    valid     name of the validator below
    prior     score of a validated span; ``context`` words add ``lift``
    clear     characters that may not stand directly before or after the span
    base      base spans are reported whatever their score is
    """

    name: str
    pattern: str
    guard: str
    valid: str
    prior: float
    context: tuple[str, ...]
    lift: float = 0.3
    clear: str = ""
    base: bool = True


#: In the order in which spans with one start are listed.  Possessive forms of
#: the patterns that the contract names; ``\G`` lets a match begin where the
#: last one ended inside a run of address characters.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "any", 0.9,
         ("email", "e-mail", "mail", "contact")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]", "ip", 0.7, ("ip", "address", "host", "server")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", "[0-9][\\x20-]?[0-9]", "card", 0.8,
         ("card", "visa", "mastercard", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone", 0.7, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", "[A-Z][A-Z][0-9][0-9]", "iban", 0.8,
         ("iban", "account", "bank", "bic"), clear="A-Za-z0-9", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9][0-9]-[0-9]", "any", 0.3,
         ("ssn", "social", "security", "taxpayer"), clear="0-9-", base=False),
    Kind("tel", r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "[0-9][\\x20.-][0-9]", "any", 0.3,
         ("phone", "tel", "call", "mobile", "fax"), clear="0-9+.-", base=False),
)

#: A span of an added kind counts from this score on.
MIN_SCORE = 0.6
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 40, 20


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    def term(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + term(i))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """True if the IBAN's rearranged number leaves 1 modulo 97."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(r: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v >= 65, (r * 100 + v - 55) % 97).otherwise((r * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda ch: ch != ""), F.lit(0), step) == 1


def _valid(kind: Kind, value: Column) -> Column:
    if kind.valid == "ip":  # leading zeros count for nothing
        short = F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")
        return F.forall(F.split(short, "\\."), lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind.valid == "card":
        n = F.length(_digits(value))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind.valid == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind.valid == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


#: Code points of a block of text, and items of a block of an array.
TEXT_BLOCK, ITEMS = 512, 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _with_before(items: Column, item_type: str, zero: int, merge: Callable[[Column, Column], Column]) -> Column:
    """array<struct<x, before>> of a non-empty array: what ``merge`` makes of
    ``zero`` and all items before x.  Arrays grow inside blocks only, so the
    work is linear in the items (and quadratic in the few blocks)."""
    empty = F.array().cast(f"array<struct<x:{item_type},before:int>>")

    def inside(part: Column, head: Column) -> Column:
        start = F.struct(head.alias("at"), empty.alias("out"))
        return F.aggregate(part, start, lambda s, x: F.struct(
            merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(F.struct(x.alias("x"), s["at"].alias("before")))).alias("out")), lambda s: s["out"])

    def heads(parts: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(parts, start, lambda s, part: F.struct(
            F.aggregate(part, s["at"], merge).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(all_items: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_items), F.lit(ITEMS))
        return F.transform(firsts, lambda i: F.slice(all_items, i, F.lit(ITEMS)))

    return _let(items, lambda x: _let(whole(x), lambda parts: F.flatten(F.zip_with(parts, heads(parts), inside))))


def text_blocks(text: Column) -> Column:
    """The text in blocks of ``TEXT_BLOCK`` code points, so that a piece of it is
    found without counting from the start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % TEXT_BLOCK), F.lit(0))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to before ``end`` (not before ``start``)."""
    block = lambda i: F.coalesce(F.get(blocks, i.cast("int")), F.lit(""))
    first, last = F.floor(start / TEXT_BLOCK), F.floor(end / TEXT_BLOCK)
    at, to = start % TEXT_BLOCK, end % TEXT_BLOCK
    between = F.when(last - first > 1, F.array_join(F.slice(blocks, (first + 2).cast("int"), (last - first - 1).cast("int")), "")).otherwise("")
    return F.when(first == last, F.substr(block(first), at + 1, end - start)).otherwise(
        F.concat(F.substr(block(first), at + 1), between, F.substr(block(last), F.lit(1), to)))


def proposals(kind: Kind, text: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        placed = _with_before(pairs, "struct<gap:string,value:string>", 0, lambda at, x: at + F.length(x["gap"]) + F.length(x["value"]))

        def span(p: Column) -> Column:
            start = p["before"] + F.length(p["x"]["gap"])
            return F.struct(start.alias("start"), (start + F.length(p["x"]["value"])).alias("end"), p["x"]["value"].alias("value"))

        return F.when(F.size(found) > 0, F.transform(placed, span)).otherwise(none)

    literal = len(kind.guard) == 1
    likely = F.contains(text, F.lit(kind.guard)) if literal else text.rlike(kind.guard)
    return F.when(likely, _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), spans)).otherwise(none)


SPAN = "struct<start:int,ord:int,end:int,kind:string,base:boolean,score:double>"


def _scored(kind: Kind, order: int, text: Column, blocks: Column) -> Column:
    """Confirmed spans of one kind as array<SPAN>, by start and apart."""
    words = "(^|[^a-z])(" + "|".join(kind.context) + ")([^a-z]|$)"

    def span(p: Column) -> Column:
        left = F.greatest(p["start"] - BEFORE, F.lit(0))
        near = F.lower(F.concat(_piece(blocks, left, p["start"]), F.lit(" "), _piece(blocks, p["end"], p["end"] + AFTER)))
        score = F.lit(kind.prior) + F.when(near.rlike(words), kind.lift).otherwise(0.0)
        return F.struct(p["start"].alias("start"), F.lit(order).alias("ord"), p["end"].alias("end"),
                        F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"),
                        F.least(score, F.lit(1.0)).alias("score"))

    def confirmed(p: Column) -> Column:
        ok = _valid(kind, p["value"])
        if kind.clear:
            before = F.when(p["start"] > 0, _piece(blocks, p["start"] - 1, p["start"])).otherwise("")
            after = _piece(blocks, p["end"], p["end"] + 1)
            ok = ok & ~before.rlike(f"[{kind.clear}]") & ~after.rlike(f"[{kind.clear}]")
        return ok

    out = F.transform(F.filter(proposals(kind, text), confirmed), span)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= MIN_SCORE)


def _meets(spans: Column, m: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in order and apart:
    the last of them that begins before its end, found by halving."""
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    begun = F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (step <= F.size(spans) - n) & (F.get(spans, n + step - 1)["start"] < m["end"]), n + step).otherwise(n))
    return _let(begun, lambda n: F.coalesce(F.get(spans, n - 1)["end"] > m["start"], F.lit(False)))


def spans_of(text: Column, kinds: Sequence[Kind] = KINDS) -> Column:
    """All spans of a text as array<SPAN>, ordered by start, then kind.  The work
    is linear in the text and its matches (but for sorting)."""
    body = F.coalesce(text, F.lit(""))

    def found(blocks: Column) -> Column:
        base = F.array(*[_scored(k, i, body, blocks) for i, k in enumerate(kinds) if k.base])
        more = F.concat(*[_scored(k, i, body, blocks) for i, k in enumerate(kinds) if not k.base])
        free = lambda by_kind: F.filter(more, lambda m: ~F.exists(by_kind, lambda spans: _meets(spans, m)))
        return _let(base, lambda by_kind: F.array_sort(F.concat(F.flatten(by_kind), free(by_kind))))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(body.rlike("[0-9@]"), _let(text_blocks(body), found)).otherwise(none)  # no kind without one of them


def find_pii(df: DataFrame, text: str = "text", kinds: Sequence[Kind] = KINDS, out: str = "pii_spans") -> DataFrame:
    """Adds ``out``: array of (start, ord, end, kind, base, score), ordered by
    start, then kind.  Offsets are code points, the end is exclusive.  Spans of
    added kinds that overlap a base span are dropped.  Null and empty texts
    have none; repeated rows are judged alike; other columns stay as they are
    (an input column called ``out`` is replaced).  An empty table stays empty."""
    return df.withColumn(out, spans_of(F.col(text), kinds))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds,
    the hash of the base spans and all spans.  A null id stays null."""
    df = find_pii(docs.select("doc_id", "text"))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                     F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(df: DataFrame, text: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """Replaces every span of ``text`` by ``[KIND]``; overlapping spans become
    one placeholder, named after the first.  Null texts stay null; all other
    columns stay as they are, whatever their names."""
    body = F.col(text)

    def masked(spans: Column) -> Column:
        placed = _with_before(spans, SPAN, 0, lambda at, x: F.greatest(at, x["end"]))  # the end of all spans before

        def part(blocks: Column) -> Callable[[Column], Column]:
            return lambda p: F.when(p["x"]["start"] >= p["before"], F.concat(
                _piece(blocks, p["before"], p["x"]["start"]), F.lit("["), F.upper(p["x"]["kind"]), F.lit("]"))).otherwise("")

        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return _let(text_blocks(body), lambda blocks: F.concat(
            F.array_join(F.transform(placed, part(blocks)), ""), _piece(blocks, end, F.length(body))))

    clean = _let(spans_of(body, kinds), lambda spans: F.when(F.size(spans) > 0, masked(spans)).otherwise(body))
    return df.withColumn(text, F.when(body.isNotNull(), clean))
