"""Attributes of product listings: make, model, kind, size, count, colour, pack and article number out of free text."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

# Names of colours in common languages, in folded lower case; others are learned from the corpus (see ``Vocabulary``).
COLOURS = {
    "black": "black blk schwarz noir negro nero",
    "white": "white wht weiss blanc blanco bianco",
    "grey": "grey gray grau gris grigio",
    "red": "red rot rouge rojo rosso",
    "green": "green grun vert verde",
    "navy": "navy marineblau",
    "blue": "blue blau bleu azul blu",
    "teal": "teal petrol",
    "sand": "sand beige",
    "yellow": "yellow gelb jaune amarillo giallo",
    "orange": "orange naranja arancione",
    "brown": "brown braun brun marron marrone",
    "pink": "pink rosa rose",
    "purple": "purple lila violett violet morado viola",
    "silver": "silver silber argent plata argento",
    "gold": "gold golden dore oro dorado",
    "lavender": "lavender lavendel lavande lavanda",
}
#: Units: dimension, factor to the base unit, whether it is metric (imperial sizes are rounded).
UNITS = {
    "mm": ("mm", 1, True), "cm": ("mm", 10, True), "m": ("mm", 1000, True), "mtr": ("mm", 1000, True), "metre": ("mm", 1000, True), "metres": ("mm", 1000, True), "meter": ("mm", 1000, True), "meters": ("mm", 1000, True),
    "in": ("mm", 25.4, False), "inch": ("mm", 25.4, False), "inches": ("mm", 25.4, False), '"': ("mm", 25.4, False), "ft": ("mm", 304.8, False), "feet": ("mm", 304.8, False), "foot": ("mm", 304.8, False),
    "ml": ("ml", 1, True), "cl": ("ml", 10, True), "l": ("ml", 1000, True), "liter": ("ml", 1000, True), "litre": ("ml", 1000, True), "litres": ("ml", 1000, True), "liters": ("ml", 1000, True), "fl oz": ("ml", 29.5735, False),
    "g": ("g", 1, True), "gr": ("g", 1, True), "gram": ("g", 1, True), "grams": ("g", 1, True), "kg": ("g", 1000, True), "kilo": ("g", 1000, True), "kilos": ("g", 1000, True), "lb": ("g", 453.592, False), "lbs": ("g", 453.592, False), "oz": ("g", 28.3495, False),
    "w": ("w", 1, True), "watt": ("w", 1, True), "watts": ("w", 1, True), "kw": ("w", 1000, True),
    "gb": ("gb", 1, True), "gigabyte": ("gb", 1, True), "tb": ("gb", 1000, True), "terabyte": ("gb", 1000, True),
    "bags": ("n", 1, True), "tea bags": ("n", 1, True), "beutel": ("n", 1, True), "sachets": ("n", 1, True), "ct": ("n", 1, True), "pcs": ("n", 1, True), "pieces": ("n", 1, True), "stuck": ("n", 1, True),
}
#: What shops put behind a make's name.
SUFFIXES = {"gmbh", "inc", "ltd", "europe", "official", "co", "ag", "llc"}
#: Titles that name no goods.
EMPTY_TITLES = {"", "untitled", "tbd", "test test", "n/a", "null", "title missing", "neues produkt", "no name", "(no title)", "???", "-", "none"}
EMPTY_PATTERN = re.compile(r"(?:product|artikel|item|produkt|article)\s*#?\s*\d+$")
#: Marks of omission at the end of a title.
CUT = re.compile(r"\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|\.{2,}|…)\s*$")

_COLOUR_OF = {w: c for c, words in COLOURS.items() for w in words.split()}
_UNIT_WORDS = sorted(UNITS, key=len, reverse=True)
#: What stands before a number is looked at from behind its first digit, so that places without a digit are skipped at once.
_NUMBER = r"(\d(?<![\d.,]\d)\d*(?:[.,]\d+)?)"
_SIZE = re.compile(rf"{_NUMBER}\s*(" + "|".join(re.escape(u).replace(r"\ ", r"\s?") for u in _UNIT_WORDS) + r")(?![a-z0-9])")
_PACK = re.compile(r"\b(?:pack|set)\s+of\s+(\d+)\b|\bpk\s*/\s*(\d+)\b|\b(\d+)\s*-?\s*pack\b|\b(\d+)\s*er[\s-]*(?:set|pack)\b")
_TIMES = re.compile(r"\b(\d+)\s*x(?![a-z0-9])|(?<![a-z0-9])x\s*(\d+)\b(?!\s*(?:cm|mm|m)\b)")
_COUNT = re.compile(r"\bbox\s+of\s+(\d+)\b|\b(\d+)\s*/\s*pk\b")
#: A model code: letters and digits in one word or with a joint, a blank only before four digits or more; a number with a unit behind it is none. Words without a digit near are left first.
_CODE = re.compile(
    r"(?<![a-z0-9])(?=[a-z]{1,5}+[\s.-]{0,2}\d)(?!(?:pack|set|box|of|pk|x|usb|no|nr)[\s.-]?\d)(?:([a-z]{1,5})[.-]?(\d{2,6}(?:[.-]?\d{2,4})?)|([a-z]{2,3})[\s.-]{1,2}(\d{2}[\s.-]?\d{3}|\d{4,6}))([a-z]{0,3}\d{0,3})(?![0-9a-z])(?!\s*(?:"
    + "|".join(re.escape(u).replace(r"\ ", r"\s?") for u in _UNIT_WORDS)
    + r")(?![a-z0-9]))"
)
SIGNS = re.compile(r"[^a-z0-9]")
#: A word of two signs or more.
_WORD = re.compile(r"[a-z](?:[a-z]++(?:\d{1,3}(?![a-z0-9]))?|\d{1,3}(?![a-z0-9]))")
_DELIVERY = re.compile(r"\b\d+\s*-\s*\d+\s+days?\b")


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()


#: Letters with accents (and ligatures) of the Latin, Greek and Cyrillic blocks as plain ones; accents by themselves go.
_FOLDED = {i: _plain(chr(i)) for i in range(0xA0, 0x530) if _plain(chr(i)) != chr(i)} | {i: None for i in range(0x300, 0x370)} | {0xDF: "ss", 0xA0: " "}


_OTHER = re.compile(r"[^\x00-\x7f]")


def _plain_of(m: re.Match) -> str:
    c = m.group()
    return _FOLDED.get(ord(c), c) or ""


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else _OTHER.sub(_plain_of, text)


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def rounded(value: float, tolerance: float) -> float:
    """The roundest number within ``tolerance`` of ``value``."""
    low, high = value - tolerance, value + tolerance
    step = 10 ** math.floor(math.log10(max(high, 1e-9)))
    while step > 1e-3:
        for s in (step, step / 2):
            best = round(value / s) * s
            if low <= best <= high and best > 0:
                return best
        step /= 10
    return value


@lru_cache(maxsize=50_000)
def size_of(number: str, unit: str) -> tuple[str, str]:
    """Dimension and canonical amount of a number with unit."""
    dimension, factor, metric = UNITS["tea bags" if unit.startswith("tea") else "fl oz" if unit.startswith("fl") else unit]
    digits = number.replace(",", ".")
    value = float(digits) * factor
    if not metric:
        value = rounded(value, 0.5001 * factor * 10.0 ** -(len(digits.partition(".")[2])))
    return dimension, f"{value:.6g}"


def check_digit_ok(digits: str) -> bool:
    """Whether a number of 8, 12, 13 or 14 digits has a right check digit and isn't all zeros."""
    if len(digits) not in (8, 12, 13, 14) or not digits.isdigit() or not digits.isascii() or not digits.strip("0"):
        return False
    values = digits.encode()  # the digits' bytes are 48 and up
    return (sum(values[::-2]) + 3 * sum(values[-2::-2]) - 48 * ((len(digits) + 1) // 2 + 3 * (len(digits) // 2))) % 10 == 0


def gtin_of(text: str | None) -> str | None:
    """The article number as 14 digits; None if none, damaged or all zeros."""
    if not text:
        return None
    digits = text.replace("-", "").replace(" ", "")
    return digits.zfill(14) if check_digit_ok(digits) else None


@lru_cache(maxsize=100_000)
def make_of(vendor: str | None, domain: str | None) -> str:
    """The make's name without what surrounds it; blank if missing or the shop itself."""
    if not vendor or not vendor.strip():
        return ""
    words = [w for w in re.findall(r"[a-z0-9]+", fold(vendor)) if w not in SUFFIXES]
    shop = re.findall(r"[a-z0-9]+", fold(domain or "").rpartition(".")[0])
    return "" if words == shop else "".join(words)


#: Parts of a file's place that name a stand-in, whatever the article.
STAND_IN = re.compile(r"placeholder|no[_-]?image|not[_-]available|dummy|coming[_-]soon|bild[_-]folgt|kein[_-]bild|blank\.|spacer|default[_-]?(?:product|image)?\.|missing[_-]?image")
_ADDRESS = re.compile(r"https?://[^/\s?#]+\.[^/\s?#]+/([^\s?#]+)")


def shows_article(address: str | None) -> bool:
    """Whether an address is a full http address of a picture of the article."""
    if not address:
        return False
    m = _ADDRESS.match(address.strip().lower())
    return bool(m) and not STAND_IN.search(m.group(1))


def price_of(text: str | None) -> float | None:
    """The amount of a price in any notation; None if missing, zero or unreadable."""
    if not text:
        return None
    if text.replace(".", "", 1).isdecimal() and text.isascii():
        value = float(text)
        return value if 0 < value < 1e9 else None
    digits = re.sub(r"[^0-9.,]", "", text)
    if "," in digits and "." in digits:
        digits = digits.replace(".", "").replace(",", ".") if digits.rfind(",") > digits.rfind(".") else digits.replace(",", "")
    elif "," in digits:
        digits = digits.replace(",", ".") if len(digits) - digits.rfind(",") == 3 else digits.replace(",", "")
    try:
        value = float(digits)
    except ValueError:
        return None
    return value if 0 < value < 1e9 else None


def title_is_cut(title: str) -> bool:
    return bool(CUT.search(title))


def title_names_goods(title: str | None) -> bool:
    """Whether a title says what is sold at all."""
    return bool(title) and _names_goods(fold(title).strip())


def _names_goods(folded: str) -> bool:
    return folded not in EMPTY_TITLES and not EMPTY_PATTERN.match(folded) and any(map(str.isalpha, folded))


#: What words say that aren't letters of a model: parts of counts and sizes.
_OF_COUNTS = frozenset("pack set of pk er x box pcs ct days".split()) | {w for u in UNITS for w in u.split() if w.isalpha()}


def stated(title: str | None) -> dict:
    """What a title states in numbers, and its other words: code, size, count, pack, words (blank if there is none), cut (its end is missing) and goods (it names some)."""
    out = {"code": "", "size": "", "count": "", "pack": "", "words": "", "cut": False, "goods": False}
    text = fold(title).strip() if title else ""
    if not text or not _names_goods(text):
        return out
    out["goods"] = True
    if text[-1] in "….])" and CUT.search(text):
        out["cut"] = True
        text = CUT.sub("", text)
        text = text.rpartition(" ")[0]  # the last word may be half a word
    if " days" in text:
        text = _DELIVERY.sub(" ", text)
    for m in _CODE.finditer(text):
        code = SIGNS.sub("", m.group(0))
        if sum(map(str.isdigit, code)) >= 3:
            out["code"] = code
            text = f"{text[: m.start()]} | {text[m.end() :]}"
            break
    m = _PACK.search(text) if "pack" in text or "set" in text or "pk" in text else None
    if m is None and "x" in text:
        m = _TIMES.search(text)
    if m:
        out["pack"] = str(int(next(g for g in m.groups() if g)))
        text = f"{text[: m.start()]} | {text[m.end() :]}"
    if ("box" in text or "/" in text) and (m := _COUNT.search(text)):
        out["count"] = str(int(next(g for g in m.groups() if g)))
        text = f"{text[: m.start()]} | {text[m.end() :]}"

    def take(m: re.Match) -> str:
        dimension, value = size_of(*m.groups())
        if dimension == "n":
            out["count"] = out["count"] or value
        elif not out["size"]:
            out["size"] = f"{value}{dimension}"
        return " "

    text = _SIZE.sub(take, text)
    out["words"] = " ".join(_WORD.findall(text))
    return out


class Vocabulary:
    """What the words of titles are: makes, variants (colours and what else tells articles of one model apart, synonyms alike), words that many makes use, and the rest, which names models."""

    def __init__(self, common: set[str] | frozenset[str], variants: dict[str, str] | None = None, known_make=None):
        self.variants = {**_COLOUR_OF, **(variants or {})}
        self.common = frozenset(common) | _OF_COUNTS | set(self.variants)
        self.known_make = known_make or (lambda word: False)
        self.near: dict[str, str] = {}
        for w in sorted(self.common):
            if len(w) >= 6 and w.isalpha():
                for d in {w} | _deletes(w):
                    self.near.setdefault(d, w)
        self.known = lru_cache(maxsize=200_000)(self._known)

    def _known(self, word: str) -> str | None:
        """The common word that ``word`` is, also misspelt: from six letters on with one letter wrong, left out, doubled or exchanged with the next, shorter ones with two exchanged or one doubled."""
        if word in self.common:
            return word
        if len(word) >= 5 and word in self.near:
            return self.near[word]
        if len(word) >= 6:
            return next((self.near.get(d, d) for d in sorted(_deletes(word)) if d in self.near or (len(d) == 5 and d in self.common)), None)
        if len(word) >= 4:
            for i in range(len(word) - 1):
                other = word[:i] + word[i] + word[i + 2 :] if word[i] == word[i + 1] else word[:i] + word[i + 1] + word[i] + word[i + 2 :]
                if len(other) >= 3 and other in self.common:
                    return other
        return None

    def roles(self, words: str, make: str) -> tuple[str, str, str]:
        """Make, name of the model and variant that ``words`` state, ``make`` being that of the vendor field."""
        said, classes = "", set()
        rest: list[str | None] = []
        for word in words.split(" ") if words else ():
            if word == make or (len(word) > 3 and self.known_make(word)):
                said = said or word
            elif (known := self.known(word)) is not None:
                if known in self.variants:
                    classes.add(self.variants[known])
            elif make and len(word) > 3 and (word in make or _near(word, make)):
                said = said or make
            else:
                rest.append(word)
                continue
            rest.append(None)
        if len(classes) > 1:
            classes.discard("blue")  # as in navy blue
        return said, _name_of(rest), "/".join(sorted(classes))


def parse_title(title: str | None, make: str, vocabulary: Vocabulary) -> dict:
    """Attributes that a title states: make, code, name, size, count, colour, pack (each blank if not stated), cut and goods."""
    out = stated(title)
    said, name, colour = vocabulary.roles(out["words"], make)
    return out | {"make": said, "name": "" if out["code"] else name, "colour": colour}


def _name_of(words: list[str | None]) -> str:
    """The model's name among the words that mean nothing else: a word of letters and digits, else the longest of six letters or more, else neighbours of three or more together."""
    for w in words:
        if w and not w.isalpha():
            return w
    long = [w for w in words if w and len(w) >= 6]
    if long:
        return max(long, key=len) if len(long) == 1 else "".join(long)
    for a, b in zip(words, words[1:]):
        if a and b and len(a) > 2 and len(b) > 2 and len(a) + len(b) >= 6:
            return a + b
    return ""


def _near(word: str, other: str) -> bool:
    if abs(len(word) - len(other)) > 1 or word[0] != other[0] and word[-1] != other[-1]:
        return False  # one letter wrong can't be both the first and the last
    return word in _deletes(other) or other in _deletes(word) or bool(_deletes(word) & _deletes(other))
