"""Statement rows from positioned text of PDF pages.

Input: items (doc, page, x, y, width, text) that a PDF library has taken out; reading the
binary format is out of scope. ``snapped`` and ``refused`` are what an extraction owes
before its items become lines. Lines of a page are grouped in order of first sight, which
has no form as a join or window, so a page (bounded) is one group. The first line that has
the headings of a table gives the columns' places; lines are cut into cells by them. A line
with a date opens a transaction, undated ones continue its description, headings, summary
lines and whatever else end it: a running count and the last such event over a document's
lines (a statement, so bounded too).
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinbrook.functions import dates
from coinbrook.functions.text import utf16_length
from coinbrook.sources.csv_statement import batched

BASELINE = 3.0
#: Least score of a document that is read as a table, and lines that the score looks at.
LEAST_SCORE, SAMPLE = 0.5, 40
#: Headings of a statement's columns, in lower case.
HEADINGS = {
    "date": ("date", "posted", "transaction date", "trans date", "posting date"),
    "description": ("description", "details", "transaction", "narrative", "particulars", "memo", "payee"),
    "amount": ("amount", "value"),
    "debit": ("debit", "debits", "withdrawal", "withdrawals", "payments", "paid out"),
    "credit": ("credit", "credits", "deposit", "deposits", "received", "paid in"),
}
#: Fixed patterns: lines that sum up, currencies, and amounts (exactly two decimals).
SUMMARY = r"(?i)\b(opening balance|closing balance|balance (brought|carried) forward|statement total|total (debits|credits|withdrawals|deposits)|subtotal|ending balance|beginning balance|page \d+ of \d+)\b"
CURRENCY = r"\b(USD|CAD|EUR|GBP|AUD|JPY|CHF|NZD)\b"
AMOUNT = r"^\(?\s*-?\$?\s*(\d{1,3}(,\d{3})*|\d+)\.\d{2}\s*\)?-?$"

#: Fixed limits of a document, and the grid of its coordinates.
MAX_PAGES, MAX_ITEMS, MAX_ITEM_LENGTH, MAX_LENGTH, LEAST_LENGTH, GRID = 100, 20_000, 2_000, 4 << 20, 24, 2
#: Least distance of a layout's score from the next one's.
MARGIN = 0.1

_CELL = "struct<x:double,text:string>"


def snapped(items: DataFrame) -> DataFrame:
    """Items with text of at most MAX_ITEM_LENGTH, at multiples of GRID (halves go up); raw_x and raw_y keep the place. What is no finite number is 0."""
    finite = lambda c: F.when(F.isnan(c) | F.abs(c).isin(float("inf")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    x = items.filter(utf16_length(F.col("text")).between(1, MAX_ITEM_LENGTH)).withColumns({"raw_x": finite("x"), "raw_y": finite("y"), "width": finite("width")})
    grid = lambda c: F.floor(F.col(c) / GRID + 0.5).cast("double") * GRID
    return x.withColumns({"x": grid("raw_x"), "y": grid("raw_y")})


def refused(items: DataFrame, documents: DataFrame) -> DataFrame:
    """doc and code of each document (doc, n_pages) that is not read, by its items as they came: no page, too many pages, too many items on a page or too much text, or less text than a page that is no image has. The first reason that holds counts.

    Two aggregations with partial sums, first by page; items of unknown documents are ignored, documents without items are images.
    """
    length = utf16_length(F.col("text"))
    own = F.when(length <= MAX_ITEM_LENGTH, length).otherwise(0)
    by_page = items.groupBy("doc", "page").agg(F.count("*").alias("n"), F.sum(own).alias("chars"))
    whole = documents.join(by_page.groupBy("doc").agg(F.max("n").alias("most"), F.sum("chars").alias("chars")), "doc", "left")
    chars = F.coalesce("chars", F.lit(0))
    code = (
        F.when(F.coalesce("n_pages", F.lit(0)) < 1, "MALFORMED_DOCUMENT")
        .when(F.col("n_pages") > MAX_PAGES, "PAGE_LIMIT_EXCEEDED")
        .when((F.col("most") > MAX_ITEMS) | (chars > MAX_LENGTH), "TEXT_LIMIT_EXCEEDED")
        .when(chars < LEAST_LENGTH, "IMAGE_ONLY_DOCUMENT")
    )
    return whole.select("doc", code.alias("code")).filter("code is not null")


def selected(detections: DataFrame) -> DataFrame:
    """doc, layout, score and problem, a row for each document of ``detections`` (doc, ordinal, layout, score, minimum: what each known layout makes of it).

    The best score wins if it reaches its layout's minimum, and if the next one does not
    reach its own or is at least MARGIN below; else layout is null and problem says why. Of
    equal scores the smaller ordinal comes first. A group has a row for each known layout.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "ordinal", "layout", "score", "minimum")))
    best = detections.groupBy("doc").agg(ranked.alias("r")).select("doc", F.get("r", F.lit(0)).alias("top"), F.get("r", F.lit(1)).alias("next"))
    close = (F.col("next.score") >= F.col("next.minimum")) & (F.round(F.col("top.score") - F.col("next.score"), 9) < MARGIN)
    problem = F.when(F.col("top.score") < F.col("top.minimum"), "no layout is likely enough").when(F.coalesce(close, F.lit(False)), "several layouts are as likely")
    return best.select("doc", F.when(problem.isNull(), F.col("top.layout")).alias("layout"), F.col("top.score").alias("score"), problem.alias("problem"))


def _grouped(items: list[dict]) -> list[tuple[str, list[dict]]]:
    """Text and cells of a page's lines; items come down the page and from left to right."""
    found: list[tuple[float, list]] = []
    for item in items:
        line = next((ln for ln in found if abs(ln[0] - item["y"]) <= BASELINE), None)
        if line is None:
            found.append(line := (item["y"], []))
        line[1].append(item)
    out = []
    for _, members in sorted(found, key=lambda ln: -ln[0]):
        text, right, members = "", None, sorted(members, key=lambda m: m["x"])
        for m in members:
            text += (" " if right is not None and m["x"] - right > 1 and not text.endswith(" ") else "") + m["text"]
            right = m["x"] + m["width"]
        out.append((text.strip(), [{"x": m["x"], "text": m["text"]} for m in members]))
    return out


def lines(items: DataFrame) -> DataFrame:
    """doc, page, line, text and cells (x, text): items within BASELINE of a line's first item are one line, left to right; lines run down the page (y grows upwards). Pages stream through a task one after the other."""
    schema = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.struct([("x", pa.float64()), ("text", pa.string())])))])

    def found(batches):
        every = (row for batch in batches for row in batch.to_pylist())
        for (doc, page), own in groupby(every, key=lambda r: (r["doc"], r["page"])):
            for k, (text, cells) in enumerate(_grouped(list(own)), 1):
                yield doc, page, k, text, cells

    kept = items.select("doc", F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width")], F.coalesce("text", F.lit("")).alias("text"))
    dealt = kept.repartition("doc", "page").sortWithinPartitions("doc", "page", F.desc("y"), "x", "text")
    return dealt.mapInArrow(lambda batches: batched(found(batches), schema), f"doc string, page int, line int, text string, cells array<{_CELL}>")


def _headings() -> list[Column]:
    """Left edges of the columns that a line's cells head, null where it has no such heading."""
    first = lambda names: F.array_min(F.transform(F.filter("cells", lambda c: F.lower(F.trim(c["text"])).isin(*names)), lambda c: c["x"]))
    return [first(names).alias(k) for k, names in HEADINGS.items()]


def _boundary(h: str = "") -> Column:
    """Where the amounts begin, if the headings make a table; else null."""
    at = lambda c: F.col(h + c)
    edge = F.coalesce(at("amount"), F.when(at("debit").isNotNull() & at("credit").isNotNull(), F.least(at("debit"), at("credit"))))
    return F.when(at("date").isNotNull() & (edge > at("description")), edge)


def layouts(page_lines: DataFrame) -> DataFrame:
    """doc and the columns' edges (date, description, amount or debit and credit, boundary) by the first line that heads a table; documents without one are missing."""
    heads = page_lines.select("doc", "page", "line", *_headings()).withColumn("boundary", _boundary()).filter("boundary is not null")
    return heads.groupBy("doc").agg(F.min(F.struct("page", "line", *HEADINGS, "boundary")).alias("h")).select("doc", *[F.col(f"h.{c}").alias(c) for c in (*HEADINGS, "boundary")])


def amount(raw: Column, debit: bool = False) -> Column:
    """Exactly two decimals; parentheses, a minus in front or behind, thousands and a dollar sign. ``debit``: the column itself means minus."""
    value = F.trim(raw)
    digits = F.regexp_replace(value, r"[(),$\s-]", "").try_cast("decimal(38,2)")
    negative = F.lit(debit) | value.contains("-") | value.rlike(r"^\(.*\)$")
    return F.when(value.rlike(AMOUNT), F.when(negative, -digits).otherwise(digits))


def cut_lines(page_lines: DataFrame) -> DataFrame:
    """Each line of the documents that have a layout, with its date, description and amount tokens, posted date and whether it is noise (headings, summaries)."""
    own = page_lines.select("*", F.struct(*_headings()).alias("own"))
    x = own.join(layouts(page_lines), "doc")
    middle = (F.col("description") + F.col("boundary")) / 2

    def joined(by: str, inside) -> Column:
        kept = F.filter(F.transform("cells", lambda c: F.struct(c["x"].alias("x"), F.trim(c["text"]).alias("text"))), lambda c: (c["text"] != "") & inside(c["x"]))
        return F.array_join(F.transform(kept, lambda c: c["text"]), by)

    split_at = (F.col("debit") + F.col("credit")) / 2
    signed = F.col("amount").isNotNull()
    out = x.select(
        "doc", "page", "line", "text", "own", signed.alias("signed"),
        joined(" ", lambda at: (at < middle) & (at < F.col("description") - 1)).alias("date_token"),
        joined(" ", lambda at: (at < middle) & (at >= F.col("description") - 1)).alias("narrative"),
        joined("", lambda at: (at >= middle) & signed).alias("amount_token"),
        joined("", lambda at: (at >= middle) & ~signed & (at < split_at)).alias("debit_token"),
        joined("", lambda at: (at >= middle) & ~signed & (at >= split_at)).alias("credit_token"),
    )
    data = dates.looks_like_pdf_date(F.col("date_token"))
    for c in ("amount_token", "debit_token", "credit_token"):
        data = data | F.trim(c).rlike(AMOUNT)
    noise = (F.col("text") == "") | F.col("text").rlike(SUMMARY) | (_boundary("own.").isNotNull() & ~data)
    return out.withColumns({"noise": noise, "posted_date": dates.pdf_date(F.col("date_token"))}).drop("own")


def rows(page_lines: DataFrame) -> DataFrame:
    """doc, row_number, posted_date, date_text, description, amount, source_location and issue of each dated row.

    issue: AMBIGUOUS_AMOUNT (debit and credit), MISSING_AMOUNT or MISSING_DESCRIPTION; null for a usable row.
    """
    by = Window.partitionBy("doc").orderBy("page", "line")
    opens = ~F.col("noise") & F.col("posted_date").isNotNull()
    continues = ~F.col("noise") & F.col("posted_date").isNull() & (F.col("date_token") == "") & (F.col("narrative") != "") & (F.col("amount_token") == "")
    marked = cut_lines(page_lines).withColumns({"opens": opens, "continues": continues})
    event = F.when(F.col("opens"), True).when(~F.col("continues"), False)
    marked = marked.withColumns({"row_number": F.sum(F.col("opens").cast("int")).over(by), "open": F.last(event, ignorenulls=True).over(by)})
    parts = F.sort_array(F.collect_list(F.struct("page", "line", "narrative")))
    place = lambda p: F.concat(F.lit("page:"), p["page"].cast("string"), F.lit("/line:"), p["line"].cast("string"))
    first = lambda c: F.max(F.when(F.col("opens"), F.col(c))).alias(c)
    gathered = marked.filter("opens or (continues and open)").groupBy("doc", "row_number", "signed").agg(
        *[first(c) for c in ("posted_date", "date_token", "amount_token", "debit_token", "credit_token")], F.array_join(F.filter(F.transform(parts, lambda p: p["narrative"]), lambda t: t != ""), " ").alias("description"), F.array_join(F.transform(parts, place), ";").alias("source_location")
    )
    debit, credit = amount(F.col("debit_token"), debit=True), amount(F.col("credit_token"))
    value = F.when(F.col("signed"), amount(F.col("amount_token"))).otherwise(F.coalesce(debit, credit))
    issue = F.when(debit.isNotNull() & credit.isNotNull(), "AMBIGUOUS_AMOUNT").when(value.isNull(), "MISSING_AMOUNT").when(F.col("description") == "", "MISSING_DESCRIPTION")
    return gathered.select("doc", "row_number", "posted_date", F.col("date_token").alias("date_text"), "description", F.when(issue.isNull(), value).alias("amount"), "source_location", issue.alias("issue"))


def detected(page_lines: DataFrame) -> DataFrame:
    """doc, score, mode (signed-amount or debit-credit), currency (the first one on the first page) and supported, a row for each document.

    A table's score is 0.4 and up to 0.3 each for the shares of dated lines and of lines
    with an amount among its first SAMPLE lines with a date or a description; 0 without a table.
    """
    w = Window.partitionBy("doc").orderBy("page", "line")
    body = cut_lines(page_lines).filter("not noise and (date_token <> '' or narrative <> '')").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE)
    paid = F.coalesce(amount(F.col("amount_token")), amount(F.col("debit_token")), amount(F.col("credit_token"))).isNotNull()
    share = lambda c: F.avg(c.cast("double"))
    scores = body.groupBy("doc").agg(F.round(0.4 + 0.3 * share(F.col("posted_date").isNotNull()) + 0.3 * share(paid), 4).alias("score"))
    named = page_lines.filter(F.regexp_extract("text", CURRENCY, 1) != "").groupBy("doc").agg(F.min(F.struct("page", "line", F.regexp_extract("text", CURRENCY, 1).alias("currency"))).alias("c"))
    all_docs = page_lines.groupBy("doc").agg(F.min("page").alias("first_page"))
    mode = F.when(F.col("amount").isNotNull(), "signed-amount").when(F.col("boundary").isNotNull(), "debit-credit")
    out = all_docs.join(layouts(page_lines), "doc", "left").join(scores, "doc", "left").join(named, "doc", "left")
    score = F.when(F.col("boundary").isNull(), F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.4)))
    return out.select("doc", score.alias("score"), mode.alias("mode"), F.when(F.col("c.page") == F.col("first_page"), F.col("c.currency")).alias("currency"), (score >= LEAST_SCORE).alias("supported"))
