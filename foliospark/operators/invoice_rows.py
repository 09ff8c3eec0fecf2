"""All invoice fields of one text after another, by the patterns of `invoice_shapes`; Python over Arrow batches.

A pattern is tried only where a word stands that all its matches begin with, and a word is looked for once in a text. What
comes out is what the columns of `invoice` give: patterns are read as Java reads them (digits, white space and word
characters are ASCII, letters of any case are equal), and money is whole cents until it is written as DECIMAL(18,2).
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from foliospark.functions.dims import INVOICE_TYPES, PAYMENT_WORDS, PLATFORMS, STATES
from foliospark.operators import invoice_shapes as shapes

#: The fields that count towards completeness.
COUNTED = (
    "billing_address", "shipping_address", "invoice_type", "order_number", "invoice_number", "order_date", "invoice_details", "invoice_date", "seller_info", "seller_pan", "seller_gst",
    "fssai_license", "billing_state_code", "shipping_state_code", "place_of_supply", "place_of_delivery", "reverse_charge", "amount_in_words", "seller_name", "seller_address", "total_tax", "total_amount",
)

# Characters that are equal to an ASCII letter when case is ignored. Ranges of capitals take the first two, others all.
_ODD = {"ſ": "s", "ı": "i", "K": "k", "İ": "i"}
_ODD_TABLE = str.maketrans(_ODD)
_ASCII = {"s": r" \t\n\x0b\f\r", "d": "0-9", "w": "A-Za-z0-9_"}
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def translated(pattern: str, any_case: bool = True) -> str:
    """The pattern as Python reads it the way that Java does."""

    def of_class(m: re.Match) -> str:
        inside = m[0]
        if m["escape"]:
            return r"\Z" if m["escape"] == "z" else "[" + _ASCII[m["escape"]] + "]" if m["escape"] in "sd" else r"(?a:\w)" if m["escape"] == "w" else inside
        plain = re.sub(r"\\([sdw])", lambda e: _ASCII[e[1]], inside)
        if inside.startswith("[^") or not any_case:
            return plain
        more = "".join(_ODD) if "a-z" in inside else "ſı" if "A-Z" in inside else ""
        return f"(?a:[{more}{plain[1:]})" if more or r"\w" in inside else plain

    return re.sub(r"\\(?P<escape>.)|\[\^?(?:\\.|[^\]\\])+\]", of_class, pattern)


def leads(pattern: str) -> tuple[str, ...]:
    """Words in lower case of which one begins each match; none if there are no such."""
    rest = re.sub(r"^(?:\^|\\b|\(\?<![^)]*\))+", "", pattern)
    opened = re.match(r"\((?:\?:)?(?=[^?])", rest)
    if opened:
        depth, parts, part = 1, [], ""
        for token in re.findall(r"\\.|\[\^?(?:\\.|[^\]\\])+\]|.", rest[opened.end() :], re.S):
            depth += (token == "(") - (token == ")")
            if depth == 0:
                break
            if token == "|" and depth == 1:
                parts, part = [*parts, part], ""
            else:
                part += token
        after = rest[opened.end() + len("|".join([*parts, part])) + 1 :][:1]
        found = [leads(x) for x in [*parts, part]]
        return tuple(w for f in found for w in f) if all(found) and after not in ("?", "*", "{") else ()
    word = re.match(r"[A-Za-z ]*", rest)[0]
    if rest[len(word) : len(word) + 1] in ("?", "*", "{"):
        word = word[:-1]
    return (word.lower(),) if word.strip() else ()


def _ascii(text: str) -> str:
    return text.encode("ascii", "replace").decode("ascii")


class Text:
    """A text, in lower case character by character (what is not ASCII as ?, so that words are found fast), and where words stand in it."""

    __slots__ = ("text", "words", "low", "_at")

    def __init__(self, text: str):
        self.text, self._at = text, {}
        if text.isascii():
            self.words = self.low = text.lower()
        elif any(c in text for c in _ODD):
            self.words, self.low = _ascii(text.lower()), _ascii(text.translate(_ODD_TABLE)).lower()
        else:
            self.words = self.low = _ascii(text).lower()

    def at(self, words: tuple[str, ...]) -> list[int]:
        found = self._at.get(words)
        if found is None:
            found, find = [], self.low.find
            for word in words:
                place = find(word)
                while place >= 0:
                    found.append(place)
                    place = find(word, place + 1)
            if len(words) > 1:
                found.sort()
            self._at[words] = found
        return found

    def has(self, *words: str) -> bool:
        return any(word in self.words for word in words)


class Shape:
    """A pattern, the words that its matches begin with, and a character that they hold (for those that begin with none)."""

    __slots__ = ("pattern", "words", "needs")

    def __init__(self, pattern: str, flags: int = re.I | re.M, needs: str = ""):
        self.needs = needs
        self.pattern, self.words = re.compile(translated(pattern, bool(flags & re.I)), flags), leads(pattern) if flags & re.I else ()

    def find(self, t: Text, end: int = 2**62) -> re.Match | None:
        if not self.words:
            return self.pattern.search(t.text, 0, end) if self.needs in t.text else None
        match, text = self.pattern.match, t.text
        for place in t.at(self.words):
            found = match(text, place, end)
            if found:
                return found
        return None

    def group(self, t: Text, end: int = 2**62) -> str | None:
        """The group of the first match; none where it is empty."""
        if self.words and not t.at(self.words):
            return None
        found = self.find(t, end)
        return (found[1] or None) if found else None

    def every(self, t: Text) -> list[re.Match]:
        if not self.words:
            return list(self.pattern.finditer(t.text))
        out, after = [], 0
        for place in t.at(self.words):
            found = self.pattern.match(t.text, place) if place >= after else None
            if found:
                out.append(found)
                after = found.end()
        return out


def _shapes(patterns: Iterable[str]) -> tuple[Shape, ...]:
    return tuple(Shape(p) for p in patterns)


def first_of(t: Text, patterns: tuple[Shape, ...], accept: Callable = lambda x: x):
    """The first pattern whose first match is accepted."""
    for p in patterns:
        found = p.group(t)
        if found is not None:
            value = accept(found)
            if value is not None:
                return value
    return None


def cents(number: str) -> int | None:
    """A number with thousands separators, rounded half up; none if it is none or has more than 16 digits before the point."""
    whole, _, rest = number.replace(",", "").partition(".")
    if not (whole or rest) or not (whole + rest).isdigit():
        return None
    whole = whole.lstrip("0")
    if len(whole) > 16:
        return None
    value = int(whole or "0") * 100 + int(rest[:2].ljust(2, "0")) + (rest[2:3] >= "5")
    return value if value < 10**18 else None


def positive(number: str) -> int | None:
    value = cents(number)
    return value if value else None


def summed(numbers: Iterable[str]) -> int | None:
    """None where there are none, or one is no number."""
    values = [cents(x) for x in numbers]
    return None if not values or None in values else _held(sum(values))


def _held(value: int) -> int | None:
    return value if value < 10**18 else None


def squeezed(text: str, most: int = 400) -> str:
    return _WHITE.sub(" ", text).strip(" ")[:most]


def longer(least: int) -> Callable[[str], str | None]:
    def accept(x: str) -> str | None:
        x = squeezed(x)
        return x if len(x) > least else None

    return accept


def long_enough(least: int) -> Callable[[str], str | None]:
    def accept(x: str) -> str | None:
        x = x.strip(" ")
        return x if len(x) >= least else None

    return accept


def _trimmed(text: str | None) -> str | None:
    return None if text is None else text.strip(" ")


_COVER = tuple(re.compile(p, re.A) for p in shapes.COVER)
_SHORT = {w for words in PLATFORMS.values() for w in words if len(w) <= 5 and w.isalpha()}
_PAN = re.compile("[a-z]{5}[0-9]{4}[a-z]")


def platform(lower: str) -> str:
    """The first platform of which the text has a word; the letters of a PAN, also within a GSTIN, are none."""
    bare = None
    for name, words in PLATFORMS.items():
        for word in words:
            if word in lower:
                if word not in _SHORT:
                    return name
                bare = _PAN.sub(" ", lower) if bare is None else bare
                if word in bare:
                    return name
    return "unknown"


# After a line's start or end by these marks a part may begin too, as where its end is looked for lines end in other ways as well.
_ENDS = "[\r\x85\u2028\u2029]"
_SECOND = {
    name: tuple((Shape(m), re.compile(translated(m).replace("^", rf"(?:^|(?<={_ENDS})(?!\n))").replace("$", f"(?:$|(?={_ENDS}))"), re.I | re.M)) for m in marks) for name, marks in shapes.SECOND_INVOICE.items()
}


def sellers_part(t: Text, shop: str) -> Text:
    """The text before the shop's own fee invoice."""
    for mark, begins in _SECOND.get(shop, ()):
        if mark.find(t):
            return Text(t.text[: begins.search(t.text).start()])
    return t


_STACKED, _BILLING, _SHIPPING = _shapes(shapes.STACKED), _shapes(shapes.BILLING_ADDRESS), _shapes(shapes.SHIPPING_ADDRESS)
_ADDRESS = longer(8)


def billing_address(t: Text, shop: str) -> str | None:
    own = ", ".join(x.strip(" ") for x in (p.group(t) for p in _STACKED) if x is not None) if shop == "blinkit" else None
    return own or first_of(t, _BILLING, _ADDRESS)


_ORDER_NUMBER, _INVOICE_NUMBER = tuple(Shape(p, needs="-" if "-" in p else "") for p in shapes.ORDER_NUMBER), _shapes(shapes.INVOICE_NUMBER)
_INVOICE_NUMBER_OF = {"myntra": _shapes(shapes.INVOICE_NUMBER_MYNTRA), "blinkit": _shapes([shapes.INVOICE_NUMBER_BLINKIT])}
_ORDER_DATE, _INVOICE_DATE = _shapes(shapes.ORDER_DATE), _shapes(shapes.INVOICE_DATE)
_SELLER_INFO, _SELLER_NAME, _SELLER_ADDRESS = _shapes(shapes.SELLER_INFO), _shapes(shapes.SELLER_NAME), _shapes(shapes.SELLER_ADDRESS)
_LABEL_LEFT = re.compile(r"^(?:Seller|Ship\s+From|Bill\s+From)\s*[:\n]+\s*", re.I | re.A)
_LABEL_RIGHT = re.compile(rf"[ *,]+(?={_ENDS}?\Z)")
_FROM = re.compile("^(?:ship|bill|invoice) from", re.I | re.A)
_ADDRESS_ENDS = re.compile(shapes.SELLER_ADDRESS_ENDS, re.A)


def _name(x: str) -> str | None:
    x = _LABEL_RIGHT.sub("", _LABEL_LEFT.sub("", x)).strip(" ")
    return x[:150] if len(x) > 3 and not _FROM.search(x) else None


def _without_notes(x: str) -> str | None:
    x = _ADDRESS_ENDS.sub(r"\1", squeezed(x))
    return x if len(x) > 10 else None


_BUYERS_BLOCK, _BUYERS_BLOCK_ASCII = re.compile(translated(shapes.BUYERS_BLOCK), re.I | re.M), re.compile(shapes.BUYERS_BLOCK, re.I | re.A)
_GST_MYNTRA, _GST, _ANY_GST = Shape(shapes.SELLER_GST_MYNTRA), Shape(shapes.SELLER_GST), Shape(shapes.ANY_GST, 0)


def seller_gst(t: Text, shop: str) -> str | None:
    """From the part before the buyer's block (or the first 2500 characters), else the first anywhere."""
    own = _GST_MYNTRA.group(t) if shop == "myntra" else None
    if own is None:
        end = 2500
        if _BUYERS_BLOCK.search(t.text):
            block = _BUYERS_BLOCK_ASCII.search(t.text)
            end = block.start() if block else 0
        own = _GST.group(t, end)
    return _ANY_GST.group(t) if own is None else own


_SELLER_PAN, _FSSAI, _STATE_CODE = _shapes(shapes.SELLER_PAN), Shape(shapes.FSSAI), Shape(shapes.STATE_CODE)
_PLACE_OF_SUPPLY, _PLACE_OF_DELIVERY, _REVERSE = _shapes([shapes.PLACE_OF_SUPPLY]), Shape(shapes.PLACE_OF_DELIVERY), Shape(shapes.REVERSE_CHARGE)
_STATES_LOW = {name.lower(): name for name in STATES.values()}


def state_label(code: str | None) -> str | None:
    """"NN - Name", or the code alone where it has no name."""
    if code is None:
        return None
    code = code.rjust(2, "0")[:2]
    return f"{code} - {STATES[code]}" if code in STATES else code


def state_in(address: str | None) -> str | None:
    """The first state that the address names, else what follows its last comma."""
    if address is None:
        return None
    low = address.lower()
    for state, name in _STATES_LOW.items():
        if state in low:
            return name
    return address.rpartition(",")[2].strip(" ")[:60] or None if "," in address else None


_IN_WORDS = _shapes(shapes.AMOUNT_IN_WORDS)
_ABOVE_WORDS, _WORDS_BELOW = (re.compile(translated(p), re.I | re.M) for p in (shapes.TOTAL_ABOVE_WORDS, shapes.WORDS_BELOW))
_TOTAL, _TOTAL_TAX = _shapes(shapes.TOTAL_AMOUNT), _shapes(shapes.TOTAL_TAX)


def _said(x: str) -> str | None:
    x = x.strip(" ")
    return x[:300] if len(x) > 5 else None


def total_amount(t: Text) -> int | None:
    below = _WORDS_BELOW.search(t.text) if "amount" in t.words else None
    if below:
        # The number can only be on the last line above.
        found = _ABOVE_WORDS.search(t.text, t.text.rfind("\n", 0, len(t.text[: below.start()].rstrip(" \t\n\v\f\r"))) + 1)
        first = positive(found[1]) if found else None
        if first is not None:
            return first
    return first_of(t, _TOTAL, positive)


_TAX = {name: _shapes(shapes.tax(name)) for name in ("CGST", "SGST", "IGST")}
_IGST_OF = {shop: _shapes(patterns) for shop, patterns in shapes.IGST_OF_SHOP.items()}
_THREE_SUMS, _SIGNED_FIGURE, _FIGURE = Shape(shapes.THREE_SUMS), Shape(shapes.SIGNED_FIGURE), Shape(shapes.FIGURE)
_TABLE_ROWS, _TAXABLE_ROWS = _shapes(shapes.TABLE_ROWS), Shape(shapes.TAXABLE_ROWS)
_PAIR = {name: _shapes(shapes.tax_pair(name)) for name in ("CGST", "SGST")}
_RUPEES = {name: Shape(rf"{name}\s+Rs\s+{shapes.NUMBER}") for name in ("CGST", "SGST")}


def _part(start: str, end: str) -> Shape:
    return Shape(rf"{start}(.*?)(?:{end}|\z)", re.I | re.S)


_TABLE, _JOINED = {n: _part(*shapes.table_of(n)) for n in ("CGST", "SGST")}, {n: _part(*shapes.joined_table_of(n)) for n in ("CGST", "SGST")}
_TAXABLE_TABLE = _part(*shapes.TAXABLE_TABLE)


def tax(t: Text, name: str) -> int | None:
    """All figures behind the tax's name, each value once; where the largest is the sum of the rest, it is the total."""
    found = [cents(m[1]) for p in _TAX[name] for m in p.every(t)]
    values = list(dict.fromkeys(x for x in found if x))
    if not values:
        return None
    total, most = sum(values), max(values)
    return _held(total) if len(values) > 1 and abs(total - most - most) >= 2 else most


def _groups(shape: Shape, t: Text) -> list[str]:
    return [m[1] for m in shape.every(t)]


def tax_of_shop(t: Text, name: str, shop: str) -> int | None:
    """The shop's table where it has one; none to fall back on the general rule."""
    value = None
    if name == "IGST":
        if shop in _IGST_OF:
            found = first_of(t, _IGST_OF[shop])
            value = None if found is None else positive(found)
        if value is None and shop == "myntra":
            # Of rows that end in three amounts, the middle of the first in which it is what the first lacks of the last.
            for m in _THREE_SUMS.every(t):
                a, b, c = map(cents, m.groups())
                if None not in (a, b, c) and abs(a + b - c) < 100 and b > 0:
                    return b
        return value
    if shop == "bigbasket":
        table = Text(_TABLE[name].group(t) or "")
        for row in _TABLE_ROWS:
            value = summed(_groups(row, table)) if value is None else value
        if value is None:
            # The sum of each third figure: taxed rows of sale, taxable value and tax whose lines have run together.
            joined = Text(_JOINED[name].group(t) or "")
            value = summed((_groups(_SIGNED_FIGURE, joined) or _groups(_FIGURE, joined))[2::3])
    elif shop == "myntra":
        found = _RUPEES[name].group(t)
        value = None if found is None else positive(found)
    elif shop in ("blinkit", "zomato", "swiggy"):
        pair, item = _PAIR[name]
        found = pair.group(t) if shop != "swiggy" else None
        value = None if found is None else positive(found)
        value = summed(_groups(item, t)) if value is None else value
    return value


_SUBTOTAL, _NO_SUBTOTAL = _shapes(shapes.SUBTOTAL), tuple(Shape(p, re.I | re.A) for p in shapes.NO_SUBTOTAL)


def subtotal(t: Text, shop: str) -> int | None:
    value = summed(_groups(_TAXABLE_ROWS, Text(_TAXABLE_TABLE.group(t) or ""))) if shop == "bigbasket" else None
    return first_of(t, _SUBTOTAL, cents) if value is None and not any(p.find(t) for p in _NO_SUBTOTAL) else value


_CHARGES = {name: _shapes(patterns) for name, patterns in shapes.CHARGES.items()}
_RATE = {name: Shape(shapes.rate(name)) for name in ("CGST", "SGST", "IGST")}
_BUYER, _PHONE, _PAYMENT = _shapes(shapes.BUYER_NAME), Shape(shapes.PHONE), Shape(shapes.PAYMENT)
_NO_NAME = re.compile(r"^\s*(?:the |invoice|address)", re.I | re.A)
_PAID_BY = {w: " ".join(x.capitalize() for x in w.split(" ")) for w in PAYMENT_WORDS}
_ITEM = Shape(shapes.ITEM)


def _buyer(x: str) -> str | None:
    name = x.strip(" ")
    return name if len(name) > 2 and not _NO_NAME.search(x) else None


def payment(t: Text) -> str | None:
    labelled = _PAYMENT.group(t)
    return _trimmed(labelled) if labelled is not None else next((shown for w, shown in _PAID_BY.items() if w in t.words), None)


def items(t: Text) -> list[tuple[str, int | None]] | None:
    """(hsn_code, total_price) of each line with an HSN code and a last amount."""
    return [(m[1], cents(m[2])) for m in _ITEM.every(t)] or None


def read(text: str | None) -> dict:
    """All fields of a text by name; money in cents."""
    text = text or ""
    if "tudoc" in text.lower() or "lOMoARcPSD" in text or "Downloaded by" in text:
        for cover in _COVER:
            text = cover.sub("", text)
    whole = Text(text)
    shop = platform(whole.words)
    t = sellers_part(whole, shop)
    gst, billing = seller_gst(t, shop), billing_address(t, shop)
    shipping = first_of(t, _SHIPPING, _ADDRESS) if t.has("ship", "delivery", "invoice") else None
    if shipping is None and shop in ("bigbasket", "blinkit"):
        shipping = billing
    taxes = {}
    for name in ("CGST", "SGST", "IGST"):
        own = tax_of_shop(t, name, shop)
        taxes[name] = tax(t, name) if own is None and t.has(name.lower()) else own
    number = first_of(t, _INVOICE_NUMBER_OF[shop]) if shop in _INVOICE_NUMBER_OF else None
    code = state_label(_STATE_CODE.group(t))
    code = state_label(gst and gst[:2]) if code is None else code
    supply = first_of(t, _PLACE_OF_SUPPLY, lambda x: x[:80].strip(" ") or None)
    delivery = _trimmed(_PLACE_OF_DELIVERY.group(t))
    reverse = _REVERSE.group(t)
    stated = first_of(t, _TOTAL_TAX, positive)
    parts = sum(x or 0 for x in taxes.values())
    percent = "%" in t.words
    rates = {name: p.group(t) if percent else None for name, p in _RATE.items()}
    found = {
        "platform": shop, "seller_gst": gst, "billing_address": billing, "shipping_address": shipping, **{f"{n.lower()}_amount": v for n, v in taxes.items()},
        "invoice_type": next((shown for w, shown in INVOICE_TYPES.items() if w in t.words), None), "order_number": first_of(whole, _ORDER_NUMBER, long_enough(5)),
        "invoice_number": first_of(t, _INVOICE_NUMBER, long_enough(5)) if number is None else number, "order_date": first_of(whole, _ORDER_DATE, long_enough(6)), "invoice_details": None,
        "invoice_date": first_of(t, _INVOICE_DATE, long_enough(6)), "seller_info": first_of(t, _SELLER_INFO, longer(5)), "seller_pan": first_of(t, _SELLER_PAN) if t.has("pan") else None,
        "fssai_license": _FSSAI.group(t) if t.has("fssai") else None, "billing_state_code": code, "shipping_state_code": code, "place_of_supply": state_label(gst and gst[:2]) if supply is None else supply,
        "place_of_delivery": state_in(shipping) if delivery is None else delivery, "reverse_charge": reverse.capitalize() if reverse else "No",
        "amount_in_words": first_of(t, _IN_WORDS, _said) if t.has("words", "only") else None, "seller_name": first_of(t, _SELLER_NAME, _name), "seller_address": first_of(t, _SELLER_ADDRESS, _without_notes),
        "total_amount": total_amount(t), "buyer_name": first_of(t, _BUYER, _buyer), "buyer_phone": _trimmed(_PHONE.group(t)) if t.has("mobile", "phone", "tel") else None, "subtotal": subtotal(t, shop),
        **{f"{n.lower()}_rate": None if x is None else float(x) for n, x in rates.items()}, **{n: first_of(t, p, positive) if t.has(*shapes.CHARGE_WORDS[n]) else None for n, p in _CHARGES.items()},
        "payment_method": payment(whole), "items": items(t), "total_tax": stated if stated is not None else _held(parts) if parts > 0 else None,
    }
    found["fields_extracted"] = sum(found[c] is not None and found[c] not in ("", "0", 0) and found[c] != "0.00" for c in COUNTED)
    return found


_MONEY = ("cgst_amount", "sgst_amount", "igst_amount", "total_amount", "subtotal", "discount", "delivery_charge", "packaging_charge", "total_tax")
_RATES = ("cgst_rate", "sgst_rate", "igst_rate")
_DECIMAL = pa.decimal128(18, 2)


def _type(name: str) -> str:
    if name == "items":
        return "array<struct<hsn_code: string, total_price: decimal(18,2)>>"
    return "decimal(18,2)" if name in _MONEY else "double" if name in _RATES else "int" if name == "fields_extracted" else "string"


NAMES = tuple(read(""))
#: What `read_all` adds to the columns before the text.
SCHEMA = ", ".join(f"{name} {_type(name)}" for name in NAMES)


def _decimals(values: list[int | None]) -> pa.Array:
    """Cents as decimals, by the bytes that Arrow keeps them in."""
    there = np.fromiter((v is not None for v in values), bool, len(values))
    halves = np.zeros((len(values), 2), np.int64)
    halves[:, 0] = np.fromiter((v or 0 for v in values), np.int64, len(values))
    halves[:, 1] = halves[:, 0] >> 63
    valid = None if there.all() else pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(_DECIMAL, len(values), [valid, pa.py_buffer(halves.tobytes())])


def _items(values: list) -> pa.Array:
    flat = [x for v in values if v for x in v]
    inner = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), _decimals([x[1] for x in flat])], ["hsn_code", "total_price"])
    ends = np.cumsum([0, *(len(v or ()) for v in values)])
    offsets = pa.array(ends, pa.int32(), mask=np.array([*(v is None for v in values), False], bool))
    return pa.ListArray.from_arrays(offsets, inner)


def _column(name: str, values: list) -> pa.Array:
    if name == "items":
        return _items(values)
    return _decimals(values) if name in _MONEY else pa.array(values, pa.float64() if name in _RATES else pa.int32() if name == "fields_extracted" else pa.string())


def _read(texts: list[str | None]) -> list[dict]:
    """Nothing that is made here refers to itself, so the collector, which would look through all rows again and again, waits."""
    waits = gc.isenabled()
    gc.disable()
    try:
        return [read(text) for text in texts]
    finally:
        if waits:
            gc.enable()


def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last, which is the text, and its fields."""
    for batch in batches:
        rows = _read(batch.column(batch.num_columns - 1).to_pylist())
        kept = [(batch.schema.field(i).name, batch.column(i)) for i in range(batch.num_columns - 1)]
        added = [(name, _column(name, [r[name] for r in rows])) for name in NAMES]
        yield pa.RecordBatch.from_arrays([c for _, c in kept + added], names=[n for n, _ in kept + added])
