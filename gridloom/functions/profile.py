"""What a document family's rows look like: the rules, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# The columns, patterns and words that results depend on.
AMOUNT = r"£\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?"
PRICE = r"£\d{1,3}(?:,\d{3})*\.\d{2}"

OUTPUT_COLUMNS = (
    "Image", "Product Description", "Case Size", "Midas Code", "EAN Barcode", "Prom WSP",
    "Std RSP", "Consumer Deal", "Promo POR", "Leaflet", "Feature Space", "Shelf",
)

COLUMN_PATTERNS = {
    "Case Size": r"\d+(?:\.\d+)?(?:\s*[xX]\s*\d+(?:\.\d+)?)*\s*(?:[A-Za-z]{1,4})?",
    "Prom WSP": PRICE,
    "Std RSP": PRICE,
    "Promo POR": r"-?\d{1,3}(?:\.\d{1,2})?%",
    "Shelf": r"\d{1,3}",
    "Image": r"\d{1,3}",
    "Leaflet": r"(?:Yes|No)",
    "Feature Space": r"(?!.*(?:£\s?\d|\d\s?%)).*",
}

DEAL_PATTERNS = (
    AMOUNT,
    rf"HALF PRICE\s*:?\s*{AMOUNT}",
    rf"(?:ANY\s+|BUY\s+)?\d{{1,2}}\s+FOR\s+{AMOUNT}",
    r"\d{1,2}\s+FOR\s+\d{1,2}",
    r"BUY\s+\d{1,2}\s+GET\s+\d{1,2}\s+FREE",
    rf"SAVE\s+{AMOUNT}",
    rf"{AMOUNT}\s+EACH",
    r"\d{1,3}P",
)

CONFUSED_WORDS = {"POR": "FOR", "F0R": "FOR", "FQR": "FOR", "EOR": "FOR", "FDR": "FOR"}

HEADER_NAMES = {
    "midas code": "Midas Code", "midascode": "Midas Code",
    "consumer deal": "Consumer Deal", "consumerdeal": "Consumer Deal",
    "product description": "Product Description", "productdescription": "Product Description",
    "case size": "Case Size", "casesize": "Case Size", "pack size": "Case Size", "packsize": "Case Size",
    "ean barcode": "EAN Barcode", "eanbarcode": "EAN Barcode", "barcode": "EAN Barcode",
    "prom wsp": "Prom WSP", "promwsp": "Prom WSP", "wsp": "Prom WSP",
    "std rsp": "Std RSP", "stdrsp": "Std RSP",
    "promo por": "Promo POR", "promopor": "Promo POR", "prom por": "Promo POR", "por": "Promo POR", "por%": "Promo POR",
    "leaflet": "Leaflet", "feature space": "Feature Space", "featurespace": "Feature Space",
    "image": "Image", "shelf": "Shelf",
}


@dataclass(frozen=True)
class Profile:
    name: str = "uk-gbp-trading-pack"
    currency: str = "£"
    foreign_symbols: tuple[str, ...] = ("$", "€", "¥", "₹")
    code: str = r"^M\d{6}$"
    code_like: str = r"^M\d{3,9}$"
    column_patterns: dict[str, str] = field(default_factory=lambda: COLUMN_PATTERNS)
    deal_patterns: tuple[str, ...] = DEAL_PATTERNS
    confused_words: dict[str, str] = field(default_factory=lambda: CONFUSED_WORDS)
    barcode_lengths: tuple[int, ...] = (8, 12, 13, 14)
    mandatory: tuple[str, ...] = ("Midas Code", "Product Description", "Consumer Deal")
    currency_columns: tuple[str, ...] = ("Prom WSP", "Std RSP", "Consumer Deal")
    required: tuple[str, ...] = ("Midas Code", "Consumer Deal")
    output_columns: tuple[str, ...] = OUTPUT_COLUMNS
    consensus_columns: tuple[str, ...] = ("Midas Code", "Consumer Deal", "Std RSP", "Prom WSP", "Promo POR")
    blocking_flags: tuple[str, ...] = ("ean_conflict", "second_pass_disagrees", "deal_group_unresolved")

    @property
    def deal(self) -> str:
        """One pattern for all deals; the case of letters does not matter."""
        return "(?i)^(?:" + "|".join(self.deal_patterns) + ")$"


ACTIVE = Profile()
