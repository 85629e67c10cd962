"""OFX statements, in SGML (1.x) and XML (2.x) form: accounts and transactions.

SGML leaves have no end tags, so no XML reader fits; each file is tokenised in a task.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.functions import dates, text
from coinbrook.sources.csv_statement import batched

MAX_DEPTH, MAX_ELEMENTS = 64, 2_000_000
#: Encodings by the name that a file declares, and by CHARSET where ENCODING is ASCII.
ENCODINGS = {
    "UTF-8": "utf-8", "UTF8": "utf-8", "UNICODE": "utf-8", "UTF-16": "utf-16",
    "US-ASCII": "windows-1252", "USASCII": "windows-1252", "ASCII": "windows-1252", "WINDOWS-1252": "windows-1252", "CP1252": "windows-1252",
    "ISO-8859-1": "iso-8859-1", "LATIN1": "iso-8859-1",
}
CHARSETS = {"1252": "windows-1252", "8859-1": "iso-8859-1", "ISO-8859-1": "iso-8859-1", "NONE": "windows-1252"}
#: Sections that are named in a warning and not read.
UNSUPPORTED = ("INVSTMTMSGSRSV1", "LOANMSGSRSV1", "BILLPAYMSGSRSV1", "SIGNUPMSGSRSV1", "PROFMSGSRSV1", "SIGNONMSGSRSV1", "INTERXFERMSGSRSV1", "WIREXFERMSGSRSV1", "EMAILMSGSRSV1")
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
_XML_ENCODING = re.compile(r"""<\?xml\b[^>]*\bencoding\s*=\s*["']([^"']+)["']""", re.I)
_HEADER = re.compile(r"^\s*([A-Za-z0-9_-]+)\s*:[^\S\r\n]*([^\r\n]*)", re.M)
_TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9._]*)\s*(/?)>([^<]*)")


def sniff(data: bytes, name: str = "") -> str:
    """ofx, pdf or csv, by the first bytes and then by the file's name."""
    head = data[:4096].lstrip(b"\xef\xbb\xbf \t\r\n")
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head.startswith(b"OFXHEADER") or b"<OFX>" in head.upper() or b"<?OFX" in head.upper():
        return "ofx"
    return {"ofx": "ofx", "qfx": "ofx", "pdf": "pdf"}.get(name.lower().rpartition(".")[2], "csv")


codecs.register_error("as-control", lambda e: (e.object[e.start : e.end].decode("latin-1"), e.end))


class Refused(ValueError):
    """A file that is not read, with the code of its reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")


def _known(names: dict, name: str) -> str:
    if (found := names.get(name.upper())) is None:
        raise Refused("UNSUPPORTED_ENCODING", f"{name} is not read")
    return found


def _declared(data: bytes, mark: str | None) -> tuple[str | None, str | None]:
    """The encoding that the XML declaration or the SGML header names, and that of a CHARSET without ENCODING; null where there is none."""
    head = data[:4096].decode(mark or "utf-8", "replace").lstrip("\ufeff").lstrip()
    if head.startswith(("<?xml", "<OFX")):
        found = _XML_ENCODING.search(head)
        return found and _known(ENCODINGS, found[1]), None
    head = data[:2048].decode("latin-1").partition("<")[0]
    fields = {k.upper(): v.strip() for k, v in _HEADER.findall(head)}
    encoding = fields.get("ENCODING")
    if encoding is None:
        return None, CHARSETS.get(fields.get("CHARSET", "").upper())
    return _known(CHARSETS, fields.get("CHARSET", "NONE")) if encoding.upper() in ("USASCII", "US-ASCII") else _known(ENCODINGS, encoding), None


def decode(data: bytes) -> str:
    """NFC text. A byte-order mark decides, and a declaration that names another encoding is refused; so are unknown names and bytes that the encoding does not have.

    Without either the file is UTF-8, or what a CHARSET alone names if it is not. Single-byte files are read as browsers do: ISO-8859-1 means windows-1252, and its five open places are control characters.
    """
    mark = next((name for start, name in _MARKS if data.startswith(start)), None)
    declared, spare = _declared(data, mark)
    if mark and declared not in (None, mark, mark[:6] if mark.startswith("utf-16") else mark):
        raise Refused("UNSUPPORTED_ENCODING", f"declared as {declared}, marked as {mark}")
    for name in (mark or declared or "utf-8", None if mark else spare):
        if name in ("windows-1252", "iso-8859-1"):
            return unicodedata.normalize("NFC", data.decode("cp1252", "as-control"))
        try:
            if name:
                return unicodedata.normalize("NFC", data.decode("utf-16le" if name == "utf-16" else name).removeprefix("\ufeff"))
        except UnicodeDecodeError:
            continue
    raise Refused("DECODE_FAILED", f"not valid {mark or declared or 'utf-8'}")


def tree(body: str) -> dict:
    """Nested lists of elements: {tag: [value or dict, ...]}; declarations, entities and CDATA raise."""
    if re.search(r"<!(DOCTYPE|ENTITY|\[CDATA)", body, re.I):
        raise Refused("UNSAFE_MARKUP", "document types, entities and CDATA are not read")
    start = re.search(r"<OFX\b", body, re.I)
    if not start:
        raise Refused("MALFORMED_DOCUMENT", "no OFX element")
    root: dict = {}
    stack: list[tuple[str, dict]] = [("", root)]
    for n, m in enumerate(_TOKEN.finditer(body, start.start())):
        close, tag, empty, value = m[1], m[2].upper(), m[3], m[4].strip()
        if n > MAX_ELEMENTS or len(stack) > MAX_DEPTH:
            raise Refused("ELEMENT_LIMIT_EXCEEDED", "too many elements, or too deep")
        if close:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    stack.pop()
                stack.pop()
        elif value or empty:
            stack[-1][1].setdefault(tag, []).append(html.unescape(value))
        else:
            child: dict = {}
            stack[-1][1].setdefault(tag, []).append(child)
            stack.append((tag, child))
    return root


def _first(node: dict, *path: str):
    for p in path:
        found = node.get(p) if isinstance(node, dict) else None
        if not found:
            return None
        node = found[0]
    return node if isinstance(node, str) else (node or None)


def _find(node: dict, tag: str):
    for t, children in node.items():
        for c in children:
            if isinstance(c, dict):
                if t == tag:
                    yield c
                yield from _find(c, tag)


def _tags(node: dict) -> set[str]:
    return set(node).union(*(_tags(c) for children in node.values() for c in children if isinstance(c, dict)))


def statements(data: bytes) -> list[dict]:
    """A row for each transaction of each statement, with its account's fields; a statement without any gives one row without. A section that is not supported gives a row that has only its name; a file without any statement is refused."""
    root, out = tree(decode(data)), []
    for kind, account in (("STMTRS", "BANKACCTFROM"), ("CCSTMTRS", "CCACCTFROM")):
        for n, s in enumerate(_find(root, kind), 1):
            base = {
                "statement": f"{kind}:{n}", "account_type": "creditCard" if kind == "CCSTMTRS" else str(_first(s, account, "ACCTTYPE") or "").lower(), "account_number": _first(s, account, "ACCTID"), "currency": _first(s, "CURDEF"),
                "ledger_balance": _first(s, "LEDGERBAL", "BALAMT"), "available_balance": _first(s, "AVAILBAL", "BALAMT"),
                "starts": _first(s, "BANKTRANLIST", "DTSTART"), "ends": _first(s, "BANKTRANLIST", "DTEND"), "balance_day": _first(s, "LEDGERBAL", "DTASOF"),
            }
            rows = [t for b in s.get("BANKTRANLIST", []) if isinstance(b, dict) for t in b.get("STMTTRN", []) if isinstance(t, dict)]
            for k, t in enumerate(rows, 1):
                out.append(base | {"row_number": k, "posted": _first(t, "DTPOSTED"), "amount_text": _first(t, "TRNAMT"), "fit_id": _first(t, "FITID"), "name": _first(t, "NAME"), "memo": _first(t, "MEMO"), "kind": _first(t, "TRNTYPE")})
            if not rows:
                out.append(base)
    if not out:
        raise Refused("MALFORMED_DOCUMENT", "no bank or credit-card statement")
    there = _tags(root)
    return out + [{"section": tag} for tag in UNSUPPORTED if tag in there]


_COLUMNS = ("statement", "account_type", "account_number", "currency", "ledger_balance", "available_balance", "starts", "ends", "balance_day", "row_number", "posted", "amount_text", "fit_id", "name", "memo", "kind", "section")
SCHEMA = ", ".join(f"{c} {'long' if c == 'row_number' else 'string'}" for c in ("path", *_COLUMNS, "problem"))


#: Fixed limit of one file.
MAX_BYTES = 16 << 20


def parsed(files: DataFrame) -> DataFrame:
    """Raw statement rows of files (path, content); a file that can't be read is one row with its problem."""
    schema = pa.schema([(c, pa.int64() if c == "row_number" else pa.string()) for c in ("path", *_COLUMNS, "problem")])

    def found(batches):
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    rows = [(*(r.get(c) for c in _COLUMNS), None) for r in statements(data.as_py() or b"")]
                except (ValueError, LookupError) as e:
                    rows = [(*[None] * len(_COLUMNS), str(e))]
                for row in rows:
                    yield p.as_py(), *row

    return files.select("path", "content").mapInArrow(lambda batches: batched(found(batches), schema), SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``parsed`` of all files under ``path``; one that is too large has that as its problem and is not loaded."""
    files = spark.read.format("binaryFile").load(path)
    kinds = {c: "long" if c == "row_number" else "string" for c in _COLUMNS}
    large = files.filter(F.col("length") > MAX_BYTES).select("path", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], F.lit(f"FILE_TOO_LARGE: more than {MAX_BYTES} bytes").alias("problem"))
    return parsed(files.filter(F.col("length") <= MAX_BYTES)).unionByName(large)


def amount(raw):
    """Decimal comma or point, no grouping, cut (not rounded) after two places."""
    ok = raw.rlike(r"^[+-]?[0-9]+([.,][0-9]*)?$")
    plain = F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), r"^(\+)", "")
    return F.when(ok, F.regexp_extract(plain, r"^(-?[0-9]+(\.[0-9]{0,2})?)", 1)).try_cast("decimal(38,2)")


def transactions(raw: DataFrame) -> DataFrame:
    """posted_date, amount, description and source_id of each readable transaction."""
    name, memo = F.trim("name"), F.trim("memo")
    described = F.substring(F.array_join(F.array_distinct(F.filter(F.array(name, memo), lambda x: x.isNotNull() & (x != ""))), " — "), 1, 1000)
    rows = raw.filter("row_number is not null").select("path", "statement", "row_number", "currency", dates.ofx_date(F.col("posted")).alias("posted_date"), amount(F.col("amount_text")).alias("amount"), described.alias("description"), F.col("fit_id").alias("source_id"))
    return rows.filter("posted_date is not null and amount is not null")


def rejected(raw: DataFrame) -> DataFrame:
    """Transactions with a bad date or amount."""
    bad = F.when(dates.ofx_date(F.col("posted")).isNull(), "INVALID_POSTED_DATE").when(amount(F.col("amount_text")).isNull(), "INVALID_AMOUNT")
    return raw.filter("row_number is not null").select("path", "statement", "row_number", bad.alias("code")).filter("code is not null")


def accounts(raw: DataFrame) -> DataFrame:
    """A row for each statement's account, with the period that the statement covers and the day of its balance (null where there is none or no such day); only the number's last digits."""
    cols = ["path", "statement", "account_type", "currency", "ledger_balance", "available_balance"]
    days = [dates.ofx_date(F.col(c)).alias(n) for c, n in (("starts", "start_date"), ("ends", "end_date"), ("balance_day", "ledger_balance_date"))]
    return raw.filter("statement is not null").select(*cols, text.mask_account(F.col("account_number")).alias("masked_number"), *days).distinct()


def issues(raw: DataFrame) -> DataFrame:
    """path, source_location, code and severity: files that are not read, and sections that are left out."""
    warned = raw.filter("section is not null").select("path", F.concat(F.lit("section:"), "section").alias("source_location"), F.lit("UNSUPPORTED_SECTION").alias("code"), F.lit("warning").alias("severity"))
    refused = raw.filter("problem is not null").select("path", F.lit(None).cast("string").alias("source_location"), F.when(F.col("problem").rlike("^[A-Z_]+: "), F.substring_index("problem", ":", 1)).otherwise("MALFORMED_DOCUMENT").alias("code"), F.lit("error").alias("severity"))
    return warned.unionByName(refused)


def formats(files: DataFrame) -> DataFrame:
    """path and format (ofx, pdf or csv) of files (path, content), by ``sniff``."""
    schema = pa.schema([("path", pa.string()), ("format", pa.string())])

    def found(batches):
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("head"), strict=True):
                yield p.as_py(), sniff(data.as_py() or b"", p.as_py() or "")

    heads = files.select("path", F.substring("content", 1, 4096).alias("head"))
    return heads.mapInArrow(lambda batches: batched(found(batches), schema), "path string, format string")
