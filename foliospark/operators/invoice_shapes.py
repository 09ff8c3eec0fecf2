"""Patterns of invoice fields, in the order that they are tried: `invoice` reads columns by them, `invoice_rows` texts.

Chosen on purpose: totals and taxes accept a colon and a currency sign after the label.
"""

from __future__ import annotations

from foliospark.functions.dims import BUYER_BEFORE_SELLER
from foliospark.functions.identifiers import GSTIN, PAN

NUMBER = r"([\d,]+\.?\d+)"
SIGN = r"\s*[:#]?\s*(?:Rs\.?|₹)?\s*"
#: A number that is no group.
N = r"[\d,]+\.?\d*"
_DATES = (
    r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?:\s+\d{2}:\d{2}:\d{2})?", r"\d{1,2}-[A-Z][a-z]+-\d{4}", r"\d{4}-\d{2}-\d{2}(?:\s+\d{2}:\d{2}:\d{2})?", r"\d{1,2}\s+\w+\s+\d{4}",
)
# How a line begins that is no longer part of a block.
_OTHER_FIELDS = (
    r"GST", r"PAN", r"CIN", r"FSSAI", r"State\b", r"Place\s+of", r"Ship", r"Bill", r"Order", r"Invoice", r"Tel\.", r"Phone", r"Email", r"IRN", r"Customer\s+(?:Type|ID|Name|Details)", r"Pin\s*code", r"IN\b",
    r"Keep\s+this", r"Terms\b", r"Supply\s+State", r"Qty\b", r"Restaurant\s+GSTIN",
)


def _lines(most: int, *stops: str) -> str:
    """Up to so many lines, none of which begins another field or one of stops."""
    return rf"((?:(?!\s*(?:{'|'.join([*_OTHER_FIELDS, *stops])}))[^\n]+\n?){{1,{most}}})"


def _block(label: str, lines: int) -> str:
    """The lines after a label."""
    return label + r"\s*[:/]?\s*\n" + _lines(lines)


def _beside(label: str, lines: int, *stops: str) -> str:
    """A block whose first line may stand on the label's own line."""
    return label + r"\s*[:\s]\s*" + _lines(lines, *stops)


def amounts(*labels: str) -> list[str]:
    return [label + SIGN + NUMBER for label in labels]


def stacked(label: str) -> str:
    """The value two lines below a label that stands alone, with a colon between."""
    return rf"^{label}\s*\n:\s*\n([^\n]+)"


#: Cover pages and marks of a document-sharing site.
COVER = (r"(?is)Scan to open on Studocu.*?lOMoARcPSD\|\d+\s*", r"lOMoARcPSD\|\d+", r"Downloaded by [^\n]+", r"Studocu is not sponsored[^\n]*")

#: Where the second invoice of a shop's document begins: the first of these that occurs.
SECOND_INVOICE = {
    "blinkit": (r"Blink\s+Commerce\s+Private\s+Limited\s*\(formerly",),
    "myntra": (r"Invoice\s+(?:Number|No)\s*:\s*I\d{4}MY",),
    "swiggy": (r"^Taxes\s+Rate\s*$", r"Invoice\s+From\s*:\s*Swiggy", r"GSTIN\s*:\s*36AAFCB7707D"),
    "zomato": (r"ETERNAL\s+LIMITED\s*\(FORMERLY\s+KNOWN\s+AS\s+ZOMATO", r"ORIGINAL\s+FOR\s+RECIPIENT\s*\nTax\s+Invoice\s*\nETERNAL"),
}

#: Labels above one another at one shop.
STACKED = tuple(stacked(x) for x in ("Name", "Address", "State"))
BILLING_ADDRESS = (
    _beside(r"Billing\s+Address", 6), *[_block(x, 6) for x in (r"Bill(?:ed)?\s+to\s*/\s*Ship\s+to", r"Bill(?:ed)?\s+To(?:\s+Address)?")],
    r"Invoice\s+To\s*\nName\s*:\s*([^\n]+)", _block(r"Invoice\s+To", 6),
    # The buyer on the label's own line ends where the seller's label begins.
    BUYER_BEFORE_SELLER, r"Customer\s+Name\s*:\s*([^\n]{3,80})", r"Customer\s+Details\s*\n(?:(?:Name|GSTIN)\s*:[^\n]+\n)*(Delivery\s+Address\s*:\s*[^\n]+)",
)
SHIPPING_ADDRESS = (
    _beside(r"Shipping\s+Address", 6), *[_block(x, 6) for x in (r"Bill\s*to\s*/?\s*Ship\s*to", r"Shipp?(?:ed)?\s+To(?:\s+Address)?")],
    r"Delivery\s+Address\s*:?\s*((?:(?!Category:|State|Pincode)[^\n]+\n?){1,4})", r"Invoice\s+To\s*\nName\s*:[^\n]+\nAddress\s*:\s*((?:(?!Pin\s*code|State|Order\s+Id)[^\n]+\n?){1,4})",
)
ORDER_NUMBER = (
    r"Order\s+(?:Number|No\.?|ID)[ \t]*[:#]?[ \t]*([A-Z0-9][\w-]{4,})", r"Order\s+(?:Number|No\.?|ID)\s*[:#]?\s*(\d[\d-]{4,})", r"\b(\d{3}-\d{7}-\d{7})\b", r"\b(\d{7}-\d{7}-\d{7})\b",
    r"\b(OD\d{12,})\b", r"\b(BNN-\d+-\d+)\b", r"\b(ORD\d{8,})\b", r"\b(\d{18,})\b",
)
_NUMBERED = r"Invoice\s+Number\s*[:#]?\s*#?\s*"
INVOICE_NUMBER_MYNTRA = (_NUMBERED + r"(I\d{4}SH\d+)", _NUMBERED + r"(I\d{4}(?!FI)[A-Z]{2}\d+)")
INVOICE_NUMBER_BLINKIT = _NUMBERED + r"(C\w{10,})"
INVOICE_NUMBER = (r"Invoice\s+(?:Number|No\.?)\s*[:#]?\s*#?\s*([A-Z0-9][A-Z0-9_/-]{4,})", r"Bill\s+(?:No|Number)\.?\s*[:#]?\s*([A-Z0-9][A-Z0-9_/-]{4,})")


def _dates(label: str, other: str) -> list[str]:
    return [x for d in _DATES for x in (rf"{label}\s+Date\s*[:#]?\s*({d})", rf"{other}\s*[:#]?\s*({d})")]


ORDER_DATE = tuple(_dates(r"Order", r"Ordered\s+on"))
INVOICE_DATE = (*_dates(r"Invoice", r"Date\s+of\s+Invoice"), *[rf"Date\s*[:#]\s*({d})" for d in _DATES])
SELLER_INFO = (
    *[_block(x, 5) for x in (r"Sold\s+By(?:\s*/\s*Seller)?", r"Details\s+of\s+Supplier", r"Bill\s+From", r"Invoice\s+From", r"Tax\s+Invoice\s+on\s+behalf\s+of\s*-")],
    r"Tax\s+Invoice\s+on\s+behalf\s+of\s*-\s*\n((?:(?!\s*(?:Invoice\s+No|Customer))[^\n]+\n?){1,6})", r"Seller\s+Name\s*:\s*([^\n]{5,80})", r"(RELIANCE\s+RETAIL\s+LIMITED[^\n]*)", r"Sold\s+By:\s*([^\n]{5,80})",
    _beside(r"Invoice\s+From", 3, "Address"),
)
SELLER_NAME = (
    r"Sold\s+By\s*[:/]?\s*([A-Z][A-Z &.-]+\b(?:LTD|LIMITED|LLP|PVT|PRIVATE|INC)\b[A-Z .]*)",
    *[x + r"\s*[:#/]?\s*([^\n]{5,80})" for x in (r"Seller\s+Name", r"Restaurant\s+Name", r"Legal\s+Entity\s+Name", r"Bill\s+From", r"Sold\s+By", r"Details\s+of\s+Supplier", r"Invoice\s+From")],
    r"(RELIANCE\s+RETAIL\s+LIMITED)",
)
_FIRST_LINE = r"\s*[:/]?\s*\n?[^\n]*\n"
SELLER_ADDRESS = (
    # A supplier's details that end in a telephone number are an address with its name.
    r"Sold\s+By" + _FIRST_LINE + _lines(4), r"Details\s+of\s+Supplier\s*\n((?:(?!\s*Tel\.)[^\n]+\n){3,9})\s*Tel\.", *[x + _FIRST_LINE + _lines(4) for x in (r"Details\s+of\s+Supplier", r"(?:Bill\s+From|Seller\s+Details?)")],
    r"(?:Invoice\s+From|Seller\s+Details?)[^\n]*\n(?:[^\n]*\n)?Address\s*:\s*" + _lines(3), r"(?:Supply/Dispatch\s+Location|Ship[-\s]from|Restaurant|Seller|Registered)\s+Address\s*[:#]?\s*" + _lines(3, "City"),
    r"Sold\s+by:\s*([^\n]+(?:\n[^\n]+){0,2}?)(?=\n\s*(?:Tax\s+is|This\s+is\s+a\s+computer|Includes))",
)
SELLER_ADDRESS_ENDS = r"(?i)^(.{11,}?)[\s,]*(?:tax is not payable|this is a computer generated|includes discounts).*$"

BUYERS_BLOCK = r"\n\s*(?:Billing\s+Address|Bill\s+To\s*\n|Invoice\s+To\s*\n|Customer\s+ID)"
SELLER_GST_MYNTRA = rf"GSTIN\s+Number\s*:\s*({GSTIN})"
SELLER_GST = rf"GST(?:IN)?(?:\s+Registration\s+No)?\s*[:#]?\s*({GSTIN})"
#: In capitals as it is.
ANY_GST = rf"\b({GSTIN})\b"
SELLER_PAN = (rf"PAN\s*(?:No)?\.?\s*[:#]?\s*({PAN})", rf"\bPAN\b[^\n]{{0,5}}({PAN})")
FSSAI = r"FSSAI\s*(?:Lic\.?|License)?\s*(?:No\.?|Number)?\s*[:#]?\s*(\d{10,18})"
STATE_CODE = r"State(?:/UT)?\s+Code\s*[:#]?\s*(\d{1,2})"
PLACE_OF_SUPPLY = r"Place\s+of\s+Supply\s*(?:&\s*State\s+Code)?\s*[:#]?\s*([^\n,]{2,60})"
PLACE_OF_DELIVERY = r"Place\s+of\s+Delivery\s*[:#]?\s*([^\n]{2,60})"
REVERSE_CHARGE = r"reverse\s+charges?\s*(?:applicable)?\s*[:#–-]?\s*(Yes|No)\b"

_IN_WORDS = r"\s*\(?in\s+words?\)?\s*[:#]?\s*(?:Rs\.?)?\s*"
_WORDS = r"((?:[A-Za-z&-]+\s+){1,40}?(?:Paisa\s+Only|Paisa|Only))\b"
#: Up to the word that ends an amount, over line ends; else the rest of the line.
AMOUNT_IN_WORDS = (
    r"Total\s+Invoice\s+value" + _IN_WORDS + _WORDS, "Amount" + _IN_WORDS + _WORDS, "Amount" + _IN_WORDS + r"([A-Z][^\n]{5,})", r"Invoice\s+total\s+in\s+words\s+([A-Z][^\n]{5,})",
    r"^\s*((?:Rupees|Rs\.?)\s+[A-Z][A-Za-z &-]+\bOnly)\b",
)
_RUPEES = r"(?:Rs\.?|₹)\s*"
#: Looks back from its word to a number, so it is tried only where the word is.
WORDS_BELOW = r"\n\s*Amount\s+\(?\s*(?:in\s+)?words"
TOTAL_ABOVE_WORDS = NUMBER + r"\s*" + WORDS_BELOW
TOTAL_AMOUNT = (
    r"Grand\s+Total" + SIGN + NUMBER, r"Total\s+Invoice\s+value\s*(?:\(\s*In\s+Figure\s*\))?" + SIGN + NUMBER, r"Final\s+Total" + SIGN + NUMBER, r"Total\s+Value\s[^\n]*?" + NUMBER + r"\s*$",
    r"Invoice\s+(?:Value|Total)" + SIGN + NUMBER, r"Balance\s+Due" + SIGN + NUMBER, rf"^TOTAL[:\s]+(?:{_RUPEES}[\d,.]+\s+)*{_RUPEES}([\d,.]+)\s*$", r"^Total\s+\d+(?:\s+-?[\d,.]+)+\s+([\d,.]+)\s*$",
    r"^Total" + SIGN + NUMBER + r"\s*$", r"\bTotal[:\s]+₹[\d,.]+\s+₹" + NUMBER,
)
TOTAL_TAX = tuple(amounts(r"Total\s+tax(?:es|\s+Amount|\s+Value)?"))


def tax(name: str) -> tuple[str, ...]:
    """A row of name, rate and tax; or the name, a rate or a currency beside it, and what is no rate."""
    return rf"^{name}\s+[\d.]+%\s+{NUMBER}\s*$", rf"{name}\s*(?:\(\s*(?:INR|₹|[\d.]+\s*%)\s*\)|@[\d.]+%)?" + SIGN + NUMBER + r"(?!\s*%)"


#: Between states: what stands for IGST at a shop.
IGST_OF_SHOP = {
    "jiomart": (rf"^Total\s+{N}\s+{N}\s+{NUMBER}\s+{N}\s*$",),
    "flipkart": (rf"IGST\s*(?:₹|Rs\.?)\s+{NUMBER}(?!\s*%)", rf"^Total\s+\d+\s+{N}\s+-?{N}\s+{N}\s+{NUMBER}\s+{N}\s*$", rf"IGST[:\s]+[\d.]+\s*%[^\n]*\n[^\n]*?{NUMBER}"),
    "myntra": (rf"^TOTAL\s+(?:Rs\s+{N}\s+){{3,}}?Rs\s+{NUMBER}\s+Rs\s+{N}\s*$",),
}
THREE_SUMS = rf"Rs\s+{NUMBER}\s+Rs\s+{NUMBER}\s+Rs\s+{NUMBER}\s*$"
SIGNED_FIGURE, FIGURE = r"Rs\.\s*([\d.]+)", r"\b(\d+\.\d{1,2})\b"


def table_of(name: str) -> tuple[str, str]:
    """Where a shop's table of a tax begins and ends."""
    return rf"{name}%\s+Sale\s+Taxable\s+Value\s+Tax\s+Value", r"[CS]GST%\s+Sale|Transaction\s+ID"


def joined_table_of(name: str) -> tuple[str, str]:
    return rf"GST\s+Information.*?{name}%", r"Transaction\s+ID|Final\s+Total"


TABLE_ROWS = (rf"{N}%\s+Rs\.\s*{N}\s+Rs\.\s*{N}\s+Rs\.\s*{NUMBER}", rf"{N}%\s+{N}\s+{N}\s+{NUMBER}")
TAXABLE_TABLE = (r"CGST%\s+Sale\s+Taxable\s+Value\s+Tax\s+Value", r"SGST%\s+Sale|Transaction\s+ID")
TAXABLE_ROWS = rf"{N}%\s+Rs\.\s*{N}\s+Rs\.\s*({N})\s+Rs\."


def tax_pair(name: str) -> tuple[str, str]:
    """CGST before SGST: in a row of totals, in the row of an item."""
    if name == "CGST":
        return rf"Total(?:\s+Value)?\s+{N}\s+{NUMBER}\s+{N}\s+{N}\s*$", rf"^\d+\s+[^\n]*?\s{N}\s+{NUMBER}\s+{N}\s+{N}\s*$"
    return rf"Total(?:\s+Value)?\s+{N}\s+{N}\s+{NUMBER}\s+{N}\s*$", rf"^\d+\s+[^\n]*?\s{N}\s+{N}\s+{NUMBER}\s+{N}\s*$"


SUBTOTAL = (
    r"Total\s+Taxable\s+Amount" + SIGN + NUMBER, rf"^Total\s+\d+\s+{N}\s+-?{N}\s+({N})\s+{N}\s+{N}\s*$", rf"Total\s+Value\s+({N})\s+{N}\s+{N}\s+{N}", rf"Item\(s\)\s+Total\s+{N}\s+{N}\s+({N})",
    r"Taxable\s+(?:Value|Amount)" + SIGN + NUMBER, r"Sub\s*-?\s*total" + SIGN + NUMBER,
)
NO_SUBTOTAL = (r"Seller\s+Name\s*:\s*KWICKBOX", r"Invoice\s+Number\s*:\s*C\w{10,}")

_LESS = r"\s*[:#]?[\s-]*(?:Rs\.?|₹)?[\s-]*"
#: Discount is printed with or without a minus.
CHARGES = {
    "discount": tuple(x + _LESS + NUMBER for x in (r"You\s+Saved", r"Discounts?\s*/?\s*Coupons?", r"Discounts?")),
    "delivery_charge": tuple(amounts(r"(?:Delivery|Shipping)\s+(?:Charge|Fee|Cost)s?")),
    "packaging_charge": tuple(amounts(r"(?<!Fees\s)(?<!Fee\s)Handling\s+Charge", r"Restaurant\s+Pack(?:ag)?ing\s+Charge\s+(?=\d+\s+0\s+\d+)", r"Pack(?:ag)?ing\s+Charges?")),
}
#: Words of which one stands wherever a charge does.
CHARGE_WORDS = {"discount": ("saved", "discount"), "delivery_charge": ("delivery", "shipping"), "packaging_charge": ("handling", "pack")}


def rate(name: str) -> str:
    return rf"{name}\s*\(?\s*%?\s*\)?\s*[:#@]?\s*\(?(\d+\.?\d*)\s*%"


BUYER_NAME = (
    r"Legal\s+Name\s*[:#]?\s*([^\n]{3,60})", r"Bill\s*to\s*/?\s*Ship\s*to\s*:?\s*\n\s*([A-Za-z .]+),", BUYER_BEFORE_SELLER, r"Customer\s+Name\s*[:#]?\s*([^\n]{3,60})", r"Invoice\s+To\s*\n\s*Name\s*[:#]?\s*([^\n]{3,60})",
    r"(?:Ship|Bill)(?:ing\s+Address|\s+To)\s*:?\s*\n\s*([A-Z][^\n]{2,60})", r"Name\s+of\s+the\s+Customer\s*[:#]?\s*([^\n]{3,60})", r"(?<!Seller\s)(?<!Legal\s)Name\s*:\s*([A-Z][^\n]{2,60})",
)
PHONE = r"(?:Mobile|Phone|Tel)\s*(?:No\.?)?\s*[:#]?\s*((?:\+?91)?[\s-]?[6-9]\d{9})"
PAYMENT = r"Payment\s+(?:Mode|Method|Type)\s*[:#]?\s*([^\n]{2,30})"
#: A line with an HSN code and a last amount: code and price.
ITEM = r"HSN[:/]?\s*(\d{4,8})[^\n]*?(?:₹|Rs\.?)\s*([\d,]+\.?\d+)\s*$"
#: In a line found, the code is its first digits and the price what it ends in.
ITEM_CODE, ITEM_PRICE = r"\d{4,8}", r"([\d,]+\.?\d+)\s*\z"
