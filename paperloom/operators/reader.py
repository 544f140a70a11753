"""What ``classify``, ``entities``, ``items`` and ``chunks`` tell of a document, a document at a time.

Their expressions give the same. Where a query asks for hundreds of them of each
document, Spark interprets their lambdas and looks each label up by a pattern of its
own, which takes many times as long. Here a batch of texts goes to a Python worker
once, labels are found as substrings, and what a set of keywords says of the type is
worked out once. ``tests/test_reader.py`` holds the two against each other.

Patterns read as they do in Java: digits, white space and the case of letters are
ASCII; words are made of letters, marks and decimal digits of any script.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from dataclasses import field as field_of
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from paperloom.functions import rules as R
from paperloom.functions.keywords import MATCHER
from paperloom.operators.entities import FIELDS

WHITE = " \t\n\x0b\f\r"
#: Bytes of texts that are looked at together; one text is never cut.
SLICE = 1 << 20


@lru_cache(1)
def _word() -> str:
    """A class of the characters of words."""
    good = [c == 0x5F or unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn") for c in range(sys.maxunicode + 1)]
    edges = np.flatnonzero(np.diff(np.array([False, *good, False]).astype(np.int8)))
    return "[" + "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in edges.reshape(-1, 2).tolist()) + "]"


@lru_cache(None)
def _pattern(pattern: str, plain: bool) -> re.Pattern:
    """A pattern of Java for texts that are ASCII (``plain``) or not."""
    if plain:
        return re.compile(pattern, re.ASCII)
    starts = r"(?:\A|(?<=[\n\x85  ])|(?<=\r)(?!\n))"
    pattern = pattern.replace("(?m)^", starts)
    w = _word() if r"\b" in pattern else ""
    return re.compile(pattern.replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"), re.ASCII)


def _has(pattern: str, text: str) -> bool:
    # A line of Java may end in a carriage return, too.
    return _pattern(pattern, text.isascii() and "\r" not in text).search(text) is not None


def lower(text: str) -> str:
    """With A-Z in lower case, each character at its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def blank(text: str | None) -> str | None:
    return (text.strip(WHITE) or None) if text is not None else None


@lru_cache(1 << 14)
def title(text: str) -> str:
    return "".join(r[0].upper() + r[1:] for r in re.findall("[a-z]+|[^a-z]+", text.lower()))


def lines(text: str) -> list[str]:
    if not text:
        return []
    if "\r" not in text:
        return (text[:-1] if text[-1] == "\n" else text).split("\n")
    return re.split(r"\r\n|\r|\n", re.sub(r"(\r\n|\r|\n)\Z", "", text))


def number(text: str | None) -> float | None:
    text = text or ""
    # Most are plain: then nothing has to be taken out.
    digits = text if text.isascii() and text.replace(".", "").isdigit() else re.sub(r"[^0-9.]", "", text)
    try:
        return float(digits) if digits else None
    except ValueError:
        return None


def shown(x: float) -> str:
    """A number as Java shows it."""
    if not np.isfinite(x):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        out = repr(float(x))
        if "e" not in out:
            return out
    sign, digits, power = _digits(x)
    if -4 < power < 7:
        whole, part = (digits[: power + 1].ljust(power + 1, "0"), digits[power + 1 :]) if power >= 0 else ("0", "0" * (-power - 1) + digits)
        return f"{sign}{whole}.{part or '0'}"
    return f"{sign}{digits[0]}.{digits[1:] or '0'}E{power}"


def _digits(x: float) -> tuple[str, str, int]:
    """Sign, significant digits and the power of ten of the first."""
    sign, body = ("-", repr(x)[1:]) if x < 0 else ("", repr(x))
    mantissa, _, power = body.partition("e")
    whole, _, part = mantissa.partition(".")
    lead = len(whole) - 1
    digits = whole + part
    skipped = len(digits) - len(digits.lstrip("0"))
    return sign, digits.strip("0") or "0", int(power or 0) + lead - skipped


def _distinct(values: list[str], cap: int) -> list[str]:
    return [v for v in dict.fromkeys(v.strip(WHITE) for v in values) if v][:cap]


def found(text: str, kind: str, small: str | None = None) -> list[str]:
    """The entities of a kind. ``small``: the text in lower case, where it is at hand; a pattern of lower case finds the same places there, and faster."""
    pattern, group, cap = R.ENTITIES[kind]
    plain = text.isascii()
    if small is None or not plain or not pattern.startswith("(?i)"):
        return _distinct([m.group(group) for m in _pattern(pattern, plain).finditer(text)], cap)
    return _distinct([text[slice(*m.span(group))] for m in _pattern(_small(pattern), True).finditer(small)], cap)


@lru_cache(None)
def _small(pattern: str) -> str:
    """A pattern without (?i), for texts in lower case."""
    return re.sub(r"\\.|[A-Z]+", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern.removeprefix("(?i)"))


def _labelled(small: str) -> bool:
    """Whether a text (in lower case) has a product label, as ``R.PRODUCT_LABEL``."""
    return any(m.start() == 0 or not _ends_word(small, m.start() - 1) for m in _PRODUCT.finditer(small))


_PRODUCT = re.compile(r"product\s*:", re.ASCII)


def _ends_word(text: str, at: int) -> bool:
    c = text[at]
    if c.isascii():
        return c.isalnum() or c == "_"
    while at >= 0 and unicodedata.category(text[at]) == "Mn":
        at -= 1
    return at >= 0 and (unicodedata.category(text[at]) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd") or text[at] == c == "_")


_PAIR = re.compile(R.KEY_VALUE, re.ASCII)


def pairs(text: str, shortest: int = 3, cap: int | None = None) -> list[tuple[str, str]]:
    """Key/value pairs in order, as in ``classify.pairs``."""
    good = [(title(k), v) for k, v in ((k.strip(WHITE), v.strip(WHITE)) for k, v in _PAIR.findall(text)) if v]
    good = [p for p in good if len(p[0]) >= shortest][:cap]
    seen: dict[str, int] = {}
    named = []
    for k, v in good:
        seen[k] = n = seen.get(k, 0) + 1
        named.append((k if n == 1 else f"{k} {n}", v))
    return named if len(dict(named)) == len(named) else _renumbered(good, named)


def _renumbered(good: list[tuple[str, str]], named: list[tuple[str, str]]) -> list[tuple[str, str]]:
    stem = lambda k: re.sub(r"( \d+)+$", "", k, flags=re.ASCII)
    counts: dict[str, int] = {}
    for k, _ in named:
        counts[k] = counts.get(k, 0) + 1
    stems = {stem(k) for k, n in counts.items() if n > 1}
    out, done, free = list(named), set(), {}
    for i, (k, v) in enumerate(good):
        if stem(k) in stems:
            name = k
            if k in done:
                # What was taken stays so: the search goes on where it ended.
                n = free.get(k, 2)
                while f"{k} {n}" in done:
                    n += 1
                free[k], name = n, f"{k} {n}"
            done.add(name)
            out[i] = (name, v)
    return out


_VALUE = re.compile(R.FIELD_VALUE, re.ASCII)


def field(text: str, small: str, labels: tuple[str, ...]) -> str | None:
    """What follows the first of the labels that has something after it; ``small`` is the text in lower case."""
    for label in labels:
        at = small.find(label)
        while at >= 0:
            m = _VALUE.match(text, at + len(label))
            if m:
                value = m.group(1).strip(WHITE)
                if value:
                    return value
                break
            at = small.find(label, at + 1)
    return None


_BITS = {name: (sum(1 << MATCHER.bits[w] for w in set(must)), sum(1 << MATCHER.bits[w] for w in set(may)), 2 * len(must) + len(may)) for name, (must, may) in R.DOCUMENT_TYPES.items()}


@lru_cache(1 << 14)
def best_type(keywords: int) -> tuple[str, float]:
    """The type of the best score, of equal ones the first, by the keywords that a text has."""
    scores = []
    for i, (name, (must, may, most)) in enumerate(_BITS.items()):
        n = (keywords & must).bit_count()
        scores.append(((n * 2 + (keywords & may).bit_count()) / most if n else 0.0, -i, name))
    score, _, name = max(scores)
    return (name if score > 0 else "UNKNOWN"), score


def classification(text: str, tabled: bool, keywords: int) -> tuple[str, float]:
    """The type of a document and how certain it is."""
    named, score = best_type(keywords)
    currency = named in R.TRADE_TYPES or score < R.KNOWN_CONFIDENCE
    currency = currency and re.search(R.CURRENCY, text) is not None
    boosts, layout = 0.0, None
    if named in R.TRADE_TYPES:
        boosts = (R.CURRENCY_BOOST if currency else 0.0) + (R.TABLE_BOOST if tabled else 0.0)
    elif named in ("CONTRACT", "EMAIL"):
        layout = _layout(text)
        boosts = (R.PROSE_BOOST if named == "CONTRACT" and layout[0] > R.PROSE_LINE else 0.0) + (R.COLON_BOOST if named == "EMAIL" and layout[1] > R.COLON_RATIO else 0.0)
    sure = min(score + boosts, 1.0)
    if sure >= R.KNOWN_CONFIDENCE:
        return named, sure
    average, colons = layout or _layout(text)
    if currency and tabled:
        kind = "FINANCIAL_DOCUMENT"
    elif colons > R.COLON_RATIO and (_has(R.DATE_ISO, text) or _has(R.DATE_DMY, text)):
        kind = "STRUCTURED_FORM"
    elif average > R.NARRATIVE_LINE:
        kind = "NARRATIVE_DOCUMENT"
    elif _has(R.NUMBERED_LINE, text) or _has(R.BULLET_LINE, text):
        kind = "LIST_DOCUMENT"
    else:
        return "UNKNOWN", sure
    return kind, min(sure, R.HEURISTIC_CAP)


def _layout(text: str) -> tuple[float, float]:
    """The average length of lines and the colons a line."""
    full = [s for s in (x.strip(WHITE) for x in lines(text)) if s]
    n = max(len(full), 1)
    return sum(map(len, full)) / n, text.count(":") / n


_TITLES = {name: tuple(x.title() for x in labels) for name, labels in R.ENRICHED_FIELDS.items()}


class Document:
    """What there is to know of a document; each part is worked out when it is first asked for."""

    def __init__(self, doc_id: str | None, text: str | None, keywords: int, raw_tables: list | None = None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.type, self.confidence = classification(self.text, has_tables(raw_tables), keywords)
        self._read(raw_tables)

    @classmethod
    def of_type(cls, kind: str | None, text: str | None, raw_tables: list | None) -> Document:
        """A document whose type is known."""
        self = cls.__new__(cls)
        self.doc_id, self.text, self.type = None, text or "", kind or ""
        self._read(raw_tables)
        return self

    def _read(self, raw_tables: list | None) -> None:
        self.tables = [table(t) for t in raw_tables or () if t]
        self.value: dict[str, str] = {}
        more = [p for t in self.tables for k, v in t.pairs if all(p := (title(k.strip(WHITE)), v.strip(WHITE)))]
        for k, v in pairs(self.text) + more:
            self.value.setdefault(k, v)
        self.pairs = list(self.value.items())
        self.small = lower(self.text)
        self._found: dict[str, list[str]] = {}

    def found(self, kind: str) -> list[str]:
        if kind not in self._found:
            self._found[kind] = found(self.text, kind, self.small)
        return self._found[kind]

    def table_rows(self) -> list[str]:
        """Rows of tables as strings, without blanks and repeats."""
        rows = [_row(x) for t in self.tables for x in ([t.pairs] if t.pairs else [zip(t.headers, row, strict=True) for row in t.rows[: R.TABLE_ROWS]])]
        return [x for x in dict.fromkeys(rows) if x][: max(len(self.tables), 1) * R.TABLE_ROWS]

    def fields(self, columns: dict[str, str | None] | None = None) -> dict[str, str | None]:
        """Fields of the type, then those that pairs fill, then columns of tables, and the total from footers."""
        wanted = R.TYPED_FIELDS.get(self.type.upper(), {})
        columns = column_values(self.tables) if columns is None else columns
        footer = next((v for t in self.tables for x in t.totals if (v := blank(x)) is not None), None)
        out = {}
        for name in FIELDS:
            value = field(self.text, self.small, wanted[name]) if name in wanted else None
            if value is None:
                value = next((v for v in (blank(self.value.get(k)) for k in _TITLES.get(name, ())) if v is not None), None)
            if value is None:
                value = columns.get(name)
            out[name] = footer if value is None and name == "total_amount" else value
        return out

    def normalise(self) -> None:
        """fields, items, totals and what identifies the document, as in ``items.normalised``."""
        self.typed = self.fields()
        self.items = line_items(self.text, self.small) if _labelled(self.small) else []
        self.order_id = self._pick("order_id")
        self.customer_id = self._nested("customer_id", "Customer Details", r"(?i)Customer\s+ID\s*[:\-]\s*(\S+)")
        self.customer_name = self._nested("customer_name", "Customer Details", r"(?i)Customer\s+Name\s*[:\-]\s*([^\n]+)")
        self.order_date = self._nested("date", "Order Details", r"(?i)Order\s+Date\s*[:\-]\s*(\S+)")
        ext = number(self._pick("total_amount"))
        self.ext_total = 0.0 if ext is None else ext
        self.calc_total = 0.0
        for i in self.items:
            self.calc_total += 0.0 if i[3] is None else i[3]
        some, agree = bool(self.items), abs(self.calc_total - self.ext_total) <= R.TOTAL_TOLERANCE
        self.total_amount = self.calc_total if some and not agree else self.ext_total
        score = (0.4 if some else 0.0) + (0.2 if some and all(i[3] is not None for i in self.items) else 0.0) + (0.2 if some and agree else 0.0)
        self.completeness = min(score + (0.1 if self.order_id is not None else 0.0) + (0.1 if self.customer_name is not None else 0.0), 1.0)

    def _pick(self, name: str) -> str | None:
        value = blank(self.typed[name])
        return blank(self.value.get(name.replace("_", " ").title())) if value is None else value

    def _nested(self, name: str, blob: str, pattern: str) -> str | None:
        value = self._pick(name)
        for text in (blank(self.value.get(blob)) or "", self.text):
            if value is None and (m := _pattern(pattern, True).search(text)):
                value = blank(m.group(1))
        return value

    def _named(self, name: str) -> str | None:
        for value in (self.typed[name], blank(self.value.get(name)), blank(self.value.get(name.replace("_", " ").title()))):
            if value is not None:
                return value
        return None

    def header(self, products: str | None = None) -> str:
        name, customer = self._named("customer_name"), self._named("customer_id")
        numbered = f"({customer})" if customer is not None else None
        of = " ".join(x for x in (name, numbered) if x is not None)
        listed = [i[0] + (f" x{shown(i[1])}" if i[1] else "") for i in [i for i in self.items if i[0]][: R.HEADER_PRODUCTS]]
        line = lambda label, v: None if v is None else label + v
        return _joined(
            line("Document: ", self.doc_id),
            f"Type: {self.type}",
            line("Order ID: ", self._named("order_id")),
            f"Customer: {of}" if of else None,
            *[line(label, self._named(n)) for label, n in (("Country: ", "country"), ("City: ", "city"), ("Date: ", "date"), ("Total: ", "total_amount"))],
            line("Products: ", products if products is not None else ", ".join(listed) if listed else None),
        )

    def summary(self) -> str:
        items = [f"  - {i[0] or 'Item'}{f' x{shown(i[1])}' if i[1] else ''} (Total: {'N/A' if i[3] is None else shown(i[3])})" for i in self.items[:10]]
        dates, totals = self.found("dates"), self.found("totals")
        return _joined(
            None if self.doc_id is None else f"Document: {self.doc_id}",
            f"Document Type: {self.type}",
            *[f"{n}: {self.typed[n]}" for n in ORDER if self.typed[n] is not None],
            "Dates: " + ", ".join(dates) if dates else None,
            f"Total: {totals[0]}" if totals else None,
            f"Line Items ({len(self.items)}):\n" + "\n".join(items) if self.items else None,
            "\n".join(f"{k}: {v}" for k, v in self.pairs[:8]) if self.pairs else None,
        )

    def about(self) -> str:
        """The entities in sections, as in ``entities.entities_text``."""
        dates, totals = self.found("dates"), self.found("totals")
        fields = [f"  {n}: {self.typed[n]}" for n in ORDER if self.typed[n] is not None]
        return _joined(
            f"[ / {self.type}]",
            "Key Fields:\n" + "\n".join(fields) if fields else None,
            "\n".join(f"Total Amount: {t}" for t in totals) or None,
            "Dates: " + ", ".join(dates) if dates else None,
            "Document Fields:\n" + "\n".join(f"  {k}: {v}" for k, v in self.pairs) if self.pairs else None,
        ).strip(WHITE)

    def chunks(self) -> list[tuple[str, int | None, str | None]]:
        """(chunk_type, page_number, text), as in ``chunks.chunk_parts``."""
        mark = None if self.doc_id is None else f"[{self.doc_id} / {self.type}]\n"
        marked = lambda text: None if mark is None else mark + text
        return [("document_header", None, self.header()), *[("page_text", 1, marked(p)) for p in page_chunks(self.text)], ("entity_summary", None, marked(self.about()))]


@dataclass
class Table:
    """A table as in ``tables.normalised``: key/value pairs, or columns, rows and what footers tell."""

    pairs: list[tuple[str, str]]
    headers: tuple[str, ...] = ()
    rows: list[list[str]] = field_of(default_factory=list)
    totals: list[str] = field_of(default_factory=list)


#: The end of a line of Java, where cells have no other line breaks.
_END = r"(?=[\x85\u2028\u2029]?\Z)"
_SPACES, _COLON = re.compile(r"\s+", re.ASCII), re.compile(rf":\s*{_END}", re.ASCII)
_KEY, _HEADER = (re.compile(x.removesuffix("$") + _END, re.ASCII) for x in (R.KEY_CELL, R.HEADER_CELL))


def _row(cells) -> str:
    return " | ".join(f"{k}: {v.strip(WHITE)}" for k, v in cells).strip(WHITE)


def has_tables(raw: list | None) -> bool:
    """As ``classify.has_tables``: a null table or row makes it unknown."""
    if not raw or any(t is None or any(r is None for r in t) for t in raw):
        return False
    return any(c is not None and c.strip(WHITE) for t in raw for r in t for c in r)


@lru_cache(1 << 14)
def _clean(cell: str) -> str:
    return _SPACES.sub(" ", cell).strip(WHITE)


def _without_colon(cell: str) -> str:
    return _COLON.sub("", cell).strip(WHITE)


def table(raw: list) -> Table:
    t = [[_clean(c or "") for c in row or ()] for row in raw]
    wide = max(map(len, t), default=0)
    left = [row[0] for row in t if row and row[0]]
    if wide == 2 and left and sum(c.endswith(":") or _KEY.search(c) is not None for c in left) >= R.KEY_TABLE_SHARE * len(left):
        kv: dict[str, str] = {}
        for row in t:
            if row and (key := _without_colon(row[0])):
                kv[key] = row[1] if len(row) > 1 else ""
        return Table(list(kv.items()))
    at = next((i for i, row in enumerate(t[: R.HEADER_ROWS], 1) if _like_header(tuple(row))), 0)
    names = _unique(_unique(t[at - 1])) if at else [f"Column_{i}" for i in range(1, max(wide, 1) + 1)]
    rows, totals = [], []
    for row in t[at:]:
        row = (row + [""] * len(names))[: len(names)]
        full = [c for c in row if c]
        labels = [i for i, c in enumerate(full) if c.lower() in R.FOOTER_LABELS]
        if labels:
            totals.append(next((full[i] for i in (labels[0] + 1, 1) if i < len(full)), ""))
        elif full:
            rows.append(row)
    return Table([], tuple(names), rows, totals)


@lru_cache(1 << 14)
def _like_header(row: tuple[str, ...]) -> bool:
    full, names = [c for c in row if c], [n for c in row if (n := _without_colon(c))]
    return bool(full) and (all(c.endswith(":") for c in full) or (bool(names) and sum(_HEADER.search(n) is not None for n in names) >= R.HEADER_SHARE * len(names)))


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in [_without_colon(x) or "Column" for x in names]:
        seen[name] = n = seen.get(name, 0) + 1
        out.append(name if n == 1 else f"{name}_{n}")
    return out


@lru_cache(1 << 16)
def likeness(label: str, name: str) -> float:
    """As ``headers.likeness``; 0 where one is blank."""
    a, b = label.strip(WHITE).lower(), name.strip(WHITE).lower()
    if not a or not b:
        return 0.0
    share = 2.0 * sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / (len(a) + len(b))
    return min(share + R.FUZZY_BONUS, 1.0) if a in b or b in a else share


@lru_cache(1 << 12)
def field_columns(names: tuple[str, ...]) -> dict[str, int]:
    """The column of each field, as in ``headers.field_columns``: that most like the first of its labels that any is like, of equal ones the first."""
    out = {}
    for name, labels in R.ENRICHED_FIELDS.items():
        for label in labels:
            score, at = max((likeness(label, x), -i) for i, x in enumerate(names))
            if score >= R.FUZZY_THRESHOLD:
                out[name] = -at
                break
    return out


def column_values(tables: list[Table]) -> dict[str, str]:
    """The first non-blank cell of the first table whose column for a field has one."""
    out: dict[str, str] = {}
    for t in tables:
        for name, at in field_columns(t.headers).items() if t.headers else ():
            if name not in out and (value := next((v for row in t.rows if (v := row[at].strip(WHITE))), None)):
                out[name] = value
    return out


#: Fields in the order in which types list them.
ORDER = list(dict.fromkeys([f for fields in R.TYPED_FIELDS.values() for f in fields] + list(R.ENRICHED_FIELDS)))


def _joined(*parts: str | None) -> str:
    return "\n".join(p for p in parts if p is not None)


#: ``R.ITEM_LABELS`` inside a line of a text in lower case, and what they fill.
_LABELS = re.compile(r"product:|quantity:|unit[ \t\x0b\f]*price:|total:", re.ASCII)
_PLACE = {"q": 1, "u": 2, "t": 3}


def line_items(text: str, small: str) -> list[list]:
    """[product, quantity, unit_price, line_total] of each item, as in ``items.line_items``; ``small`` is the text in lower case."""
    spans = [m.span() for m in _LABELS.finditer(small)]
    starts = [a for a, _ in spans[1:]] + [len(text)]
    out, begun, now, returns = [], False, [None, None, None, None], "\r" in text
    for (a, z), upto in zip(spans, starts, strict=False):
        end = text.find("\n", z, upto)
        if returns and (at := text.find("\r", z, upto if end < 0 else end)) >= 0:
            end = at
        value = text[z : upto if end < 0 else end].strip(WHITE)
        if small[a] == "p":
            if begun:
                out.append(now)
                now = [None, None, None, None]
            begun, now[0] = True, value
        elif (x := number(value)) is not None:
            now[_PLACE[small[a]]] = x
        if end >= 0 and now[0] is not None and now[1] is None:
            # Whole lines up to that of the next label go on with the name.
            last = upto if upto == len(text) else max(text.rfind("\n", end, upto), text.rfind("\r", end, upto))
            for line in lines(text[end + 1 : last]):
                if line := line.strip(WHITE):
                    now[0] = f"{now[0]} {line}".strip(WHITE)
    return [*out, now] if begun else []


def page_chunks(text: str) -> list[str]:
    """A page's text as in ``chunks.page_chunks``."""
    t = text.strip(WHITE)
    if len(t) <= R.WHOLE_PAGE:
        return [t] if t else []
    out, start = [], 0
    while True:
        w = t[start : start + R.WINDOW]
        upto = max(w.rfind(p) + len(p) if p in w else 0 for p in R.SENTENCE_ENDS)
        n = upto if 2 * (upto - 2) >= len(w) - 1 else len(w)
        if part := w[:n].strip(WHITE):
            out.append(part)
        if start + R.WINDOW >= len(t):
            return out
        start += max(n - R.OVERLAP, 1)


def _texts(column: pa.Array) -> list:
    """The strings of a column, or of its lists; bytes that are no text are replaced as Java does."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        decoded = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else None if x is None else [decoded(y) for y in x]
        kind = lambda t: pa.list_(kind(t.value_type)) if pa.types.is_list(t) else pa.binary()
        return [decoded(x) for x in column.cast(kind(column.type)).to_pylist()]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of about ``SLICE`` bytes."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    row = 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, upto - row
        row = upto


def keywords(texts: list[str | None]) -> list[int]:
    """The keywords of each text as bits."""
    encoded = [((t or "").lower() + "\n").encode("utf-8", "replace") for t in texts]
    masks = MATCHER.masks(np.frombuffer(b"".join(encoded), np.uint8), np.array([0, *accumulate(map(len, encoded))]))
    out = masks[:, 0].tolist()
    for k in range(1, masks.shape[1]):
        out = [x | y << 64 * k for x, y in zip(out, masks[:, k].tolist(), strict=True)]
    return out


def _read(docs: DataFrame, schema: str, fields: pa.Schema, rows: Callable[[Document], Iterator[tuple]]) -> DataFrame:
    """The rows that ``rows`` makes of each document: doc_id, full_text and, where there are any, raw_tables."""

    def read(batches):
        for b in batches:
            if not len(b):
                continue
            for row, n in _slices(b.column(1)):
                ids, texts = b.column(0).slice(row, n).to_pylist(), _texts(b.column(1).slice(row, n))
                tables = _texts(b.column(2).slice(row, n)) if len(b.columns) > 2 else [None] * n
                out = [r for doc, text, found, t in zip(ids, texts, keywords(texts), tables, strict=True) for r in rows(Document(doc, text, found, t))]
                columns = zip(*out, strict=True) if out else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return docs.select("doc_id", "full_text", *[c for c in ("raw_tables",) if c in docs.columns]).mapInArrow(read, schema)


_STRING, _DOUBLE = pa.string(), pa.float64()


def field_rows(docs: DataFrame) -> DataFrame:
    """doc_id, field, value of the fields that are set, after enrichment from pairs and, where documents have raw_tables, from these."""

    def rows(d: Document):
        return [(d.doc_id, name, value) for name, value in d.fields().items() if value is not None]

    return _read(docs, "doc_id string, field string, value string", pa.schema([("doc_id", _STRING), ("field", _STRING), ("value", _STRING)]), rows)


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, order_id, customer_id, customer_name, order_date, ext_total, calc_total, total_amount and confidence."""

    def rows(d: Document):
        d.normalise()
        yield d.doc_id, d.order_id, d.customer_id, d.customer_name, d.order_date, d.ext_total, d.calc_total, d.total_amount, d.completeness

    names = ["doc_id", "order_id", "customer_id", "customer_name", "order_date"], ["ext_total", "calc_total", "total_amount", "confidence"]
    schema = ", ".join([*[f"{n} string" for n in names[0]], *[f"{n} double" for n in names[1]]])
    return _read(docs, schema, pa.schema([*[(n, _STRING) for n in names[0]], *[(n, _DOUBLE) for n in names[1]]]), rows)


def _text_of(docs: DataFrame, text: Callable[[Document], str]) -> DataFrame:
    def rows(d: Document):
        d.normalise()
        yield d.doc_id, text(d)

    return _read(docs, "doc_id string, text string", pa.schema([("doc_id", _STRING), ("text", _STRING)]), rows)


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id and text: the summary of each document."""
    return _text_of(docs, Document.summary)


def headers(docs: DataFrame) -> DataFrame:
    """doc_id and text: the header chunk of each document."""
    return _text_of(docs, Document.header)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, number (from 1), chunk_type, page_number and text of each document's chunks."""

    def rows(d: Document):
        d.normalise()
        return [(d.doc_id, i, *c) for i, c in enumerate(d.chunks(), 1)]

    schema = pa.schema([("doc_id", _STRING), ("number", pa.int32()), ("chunk_type", _STRING), ("page_number", pa.int32()), ("text", _STRING)])
    return _read(docs, "doc_id string, number int, chunk_type string, page_number int, text string", schema, rows)


_KINDS, _LIST = list(R.ENTITIES), pa.list_(_STRING)
_STRINGS = ArrayType(StringType())
_PAIRS = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())]))
_ENTITIES = StructType([*[StructField(k, _STRINGS) for k in _KINDS], StructField("key_value_pairs", _PAIRS), StructField("table_entities", _STRINGS), StructField("typed_fields", StructType([StructField(f, StringType()) for f in FIELDS]))])


@F.arrow_udf(_ENTITIES)
def _entities(texts: pa.Array, types: pa.Array, raw: pa.Array, columns: pa.Array) -> pa.Array:
    out = []
    for row, n in _slices(texts):
        part = [_texts(c.slice(row, n)) for c in (texts, types, raw, columns)]
        docs = [Document.of_type(kind, text, t) for text, kind, t in zip(*part[:3], strict=True)]
        kinds = []
        for k in _KINDS:
            values = [d.found(k) for d in docs]
            if k == "totals":
                values = [_distinct(v + [x for t in d.tables for x in t.totals], R.ENTITIES[k][2]) if d.tables else v for d, v in zip(docs, values, strict=True)]
            kinds.append(pa.array(values, _LIST))
        listed = [p for d in docs for p in d.pairs]
        pairs_ = pa.StructArray.from_arrays([pa.array([p[i] for p in listed], _STRING) for i in (0, 1)], ["key", "value"])
        pairs_ = pa.ListArray.from_arrays(pa.array([0, *accumulate(len(d.pairs) for d in docs)], pa.int32()), pairs_)
        fields = [d.fields(given or {}) for d, given in zip(docs, part[3], strict=True)]
        typed = pa.StructArray.from_arrays([pa.array([f[name] for f in fields], _STRING) for name in FIELDS], FIELDS)
        out.append(pa.StructArray.from_arrays([*kinds, pairs_, pa.array([d.table_rows() for d in docs], _LIST), typed], [*_KINDS, "key_value_pairs", "table_entities", "typed_fields"]))
    return pa.concat_arrays(out)


def with_entities(df: DataFrame) -> DataFrame:
    """Adds what ``entities.extracted`` and ``entities.enriched`` do, by full_text, document_type, raw_tables and column_values."""
    return df.withColumn("__entities", _entities("full_text", "document_type", "raw_tables", "column_values")).select("*", "__entities.*").drop("__entities")
