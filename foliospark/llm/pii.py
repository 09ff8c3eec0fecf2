"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score [functions only].

A kind's spans come from one split and one extraction of the same pattern: the pieces between the matches
give the positions, in code points. Patterns are written so that a match is tried once per run of
characters (possessive, anchored by look-behind), which keeps them linear on very long runs. Every pattern
stands behind a cheap test, so most texts never reach it.

Base kinds (email, ip, card, phone) are exactly those of the published contract; the method adds
``iban`` (the country's length and mod 97, tried at each end of a token, so that words after it do not matter). Defined results: a null text is an empty one; it has no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.patterns import bound
from foliospark.llm.shared import sealed

_LOCAL = "[A-Za-z0-9._%+-]"
#: In the order in which kinds are listed where spans start together.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # The whole chain of digits, where it has 14 to 19 of them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Country and check digits; then a run that may hold the number (1), and what a token cut off by its bound goes on with (2).
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+)([A-Za-z0-9]?))",
}
BASE = ("email", "ip", "card", "phone")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Words that make a kind likelier if they stand within NEAR code points before the span.
CONTEXT = {
    "email": ("mail", "contact", "write to", "kontakt", "correo"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
}
NEAR = 40
#: Spans that are gathered together, and code points of a block of text, so that no step goes through all of a long text.
STRETCH, BLOCK = 256, 1024


def _gate(text: Column, kind: str) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}")
    return text.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}")


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start, text>> of the pattern's matches; of ibans, those that _account_number finds in them."""
    pattern = PATTERNS[kind]
    part = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    groups = [part(1).alias("run"), part(2).alias("cut")] if kind == "iban" else []
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), part(0).alias("hit"), *groups)
    found = (lambda p: _account_number(p["hit"], p["run"], p["cut"])) if kind == "iban" else (lambda p: p["hit"])
    pairs = F.transform(pairs, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("hit"), found(p).alias("text")))
    state = lambda at, free, starts: F.struct(at.alias("at"), free.alias("free"), starts.alias("starts"))

    def step(done: Column, pair: Column) -> Column:
        """starts: where each match begins; null where it is no span or lies in the one before."""
        start = done["at"] + pair["gap"]
        is_free = pair["text"].isNotNull() & (done["free"] <= start)
        free = F.when(is_free, start + F.char_length(pair["text"])).otherwise(done["free"])
        return state(start + F.coalesce(pair["hit"], F.lit(0)), free, F.concat(done["starts"], F.array(F.when(is_free, start))))

    def stretch(done: Column, some: Column) -> Column:
        here = F.aggregate(some, state(done["at"], done["free"], none), step)
        return bound(here, lambda x: state(x["at"], x["free"], F.concat(done["starts"], x["starts"])))

    def spans(pairs: Column) -> Column:
        # A list is copied when something is added to it, so starts are added to short ones, and these to the whole.
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STRETCH).cast("int")), lambda k: F.slice(pairs, k * STRETCH + 1, F.lit(STRETCH)))
        starts = F.aggregate(stretches, state(F.lit(0), F.lit(0), none), stretch, lambda done: done["starts"])
        placed = F.arrays_zip(starts.alias("start"), F.transform(pairs, lambda p: p["text"]).alias("text"))
        return F.filter(placed, lambda x: x["start"].isNotNull())

    none = F.array().cast("array<int>")
    return F.when(_gate(text, kind), bound(pairs, spans)).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def _account_number(head: Column, run: Column, cut: Column) -> Column:
    """The account number that begins with head and ends at the end of a token of run; null if there is none.

    It has the country's length and passes mod 97. Where the country has no set length, the longest of 15 to 34
    characters that passes.
    """
    tokens = F.split(run, " ")
    whole = F.size(tokens) - (cut != "").cast("int")
    ends = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    numbers = F.transform(ends, lambda n: F.concat(head, F.array_join(F.slice(tokens, F.lit(1), n), " ")))
    country = F.substring(head, 1, 2)
    length = F.coalesce(*[F.when(country.isin(names.split()), F.lit(n)) for n, names in IBAN_LENGTHS.items()])

    def fits(number: Column) -> Column:
        n = F.char_length(F.replace(number, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34) & (n == F.coalesce(length, n)), mod97(number)).otherwise(False)

    return F.try_element_at(F.filter(numbers, fits), F.lit(-1))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text pass the Luhn check."""
    digits = F.reverse(_digits(text))
    values = F.transform(
        F.sequence(F.lit(1), F.char_length(digits)),
        lambda i: F.when(i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number (country, check digits, rest) passes ISO 7064 mod 97-10."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    step = lambda n, c: F.when(c >= "A", (n * 100 + F.ascii(c) - 55) % 97).otherwise((n * 10 + F.ascii(c) - 48) % 97).cast("int")
    return F.aggregate(F.split(turned, "(?!^)(?=.)"), F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        small = lambda part: F.char_length(F.ltrim(part, F.lit("0"))) <= 3
        fits = lambda part: F.when(small(part), F.coalesce(F.try_to_number(F.nullif(F.ltrim(part, F.lit("0")), F.lit("")), F.lit("999")), F.lit(0)) <= 255).otherwise(False)
        return F.forall(F.split(text, r"\."), fits)
    if kind == "card":
        return luhn(text)
    if kind == "phone":
        return F.char_length(_digits(text)).between(10, 15)
    return F.lit(True)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``pii``: array<struct<start, rank, kind, end, text, score>> by start, then kind.

    Score: 0.5 for the pattern, 0.3 where a checksum or range test confirmed it, 0.2 for a context word.
    """
    names = docs.columns
    docs, back = sealed(docs, (text,))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("pii blocks")
    found = docs.select("*", blocks, *[_matches(whole, k).alias(f"pii {k}") for k in PATTERNS])

    def scored(kind: str, rank: int) -> Column:
        def one(x: Column) -> Column:
            start, length = x["start"], F.char_length(x["text"])
            first = F.greatest(F.floor(start / BLOCK).cast("int") - 1, F.lit(0))
            here = F.concat(*[F.coalesce(F.get("pii blocks", first + i), F.lit("")) for i in (0, 1)])
            at = start - first * BLOCK
            before = F.lower(F.substr(here, F.greatest(at - NEAR, F.lit(0)) + 1, F.least(at, F.lit(NEAR))))
            near = F.lit(False)
            for word in CONTEXT[kind]:
                near = near | F.contains(before, F.lit(word))
            score = F.lit(0.5 if kind == "email" else 0.8) + F.when(near, 0.2).otherwise(0.0)
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + length).alias("end"), x["text"].alias("text"), score.alias("score"))

        return F.transform(F.filter(f"`pii {kind}`", lambda x: _valid(kind, x["text"])), one)

    spans = F.sort_array(F.concat(*[scored(k, i) for i, k in enumerate(PATTERNS)]))
    # Names come back in a step of their own, so that no column of docs is taken for one of these.
    done = found.select(*docs.columns, spans.alias("pii"))
    return done.select(*[back[i] for i, c in enumerate(names) if c != "pii"], "pii")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
