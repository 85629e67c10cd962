"""Operators that work text by text, against plain Python over whole texts."""

import base64
import hashlib
import re
from collections import Counter

import pytest

from coinbrook.llm import bpe, langid, licenses, pii, quality
from tests.llm import rows


def test_bpe_is_tiktoken_and_round_trips(spark, sf):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = rows.documents(spark, sf)
    expected = Counter()
    for doc_id, text in rows.pairs(docs):
        ids = enc.encode_ordinary(text)
        expected[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = bpe.round_trip(docs).collect()
    assert all(r.round_trip_ok for r in got)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert bpe.round_trip(rows.empty(spark)).count() == 0


def test_bpe_offsets_cover_split_characters(spark):
    text = "né 漢字 \U0001f600!"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), offsets=True).first()
    data = text.encode()
    assert row.byte_start[0] == 0 and row.byte_end[-1] == len(data) and row.byte_start[1:] == row.byte_end[:-1]
    for bs, be, cs, ce in zip(row.byte_start, row.byte_end, row.char_start, row.char_end, strict=True):
        assert data[bs:be] in text[cs:ce].encode() and ce > cs
    back = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert back.text == text


def test_bpe_pieces_are_those_of_the_library_for_every_kind_of_character():
    import public_tokenizers as P
    import tiktoken

    coder = bpe.ByteBpe(*bpe.default_vocabulary())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}!{chr(c)}" for c in [*range(0x3000), *range(0xF900, 0x11000)] if not 0xD800 <= c < 0xE000]
    assert list(coder.encode(texts)) == [enc.encode_ordinary(t) for t in texts]


def base_scan(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_counts(spark, sf):
    docs = rows.documents(spark, sf)
    got = licenses.scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *base_scan(t)) for d, t in rows.pairs(docs))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(rows.empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files", "mit"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("licKense and liKense: general public licenſe", ""),
        ("all rights were reserved", ""),
    ],
)
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_license_spans_merge_neighbouring_diagonals(spark):
    text = "so permission is hereby granted free of charge to any natural person obtaining a copy of this software and associated documentation files"
    spans = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found_spans
    assert [(s.label, s.start) for s in spans] == [("mit", 1)] and spans[0].end == len(text.split())


def test_license_drift_is_bounded_in_all(spark):
    """Three pieces of foreign words, each short, but together wider than the band: no span; the whole text, lightly edited: one."""
    grant = next(t.words for t in licenses.TEMPLATES if t.name == "mit_grant").split()
    cut_up = [w for i, x in enumerate(grant) for w in ([x, "foo", "bar", "baz"] if i in (5, 10, 15) else [x])]
    whole = next(t.words for t in licenses.TEMPLATES if t.name == "mit_text").split()
    edited = ["copyright", "someone", *whole[:40], "really", *whole[40:90], *whole[92:], "the", "end"]
    texts = [(1, " ".join(cut_up)), (2, " ".join(edited)), (3, " ".join(whole[:60])), (2, " ".join(edited))]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in texts) and by[1].labels == ""
    assert by[2].labels == by[3].labels == "mit" and 0.9 < by[2].score <= 1
    longest = max(by[2].found_spans, key=lambda s: s.end - s.start)
    assert (longest.start, longest.end) == (2, len(edited) - 2)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_pii(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0])]


HARD = [
    "a@b@c.d.e x@@y.com .@-.- a@b.c@d.e a@b. a@b.c.",
    "1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1.1 0001.2.3.004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 1",
    "+1 (234) 567-8901 ++12345678901 +1+2345678901 +1 2 +123456789012345678",
    "é+49 30 1234567@x.de 1.1.1.1@a.b",
]


def test_pii_base(spark, sf):
    docs = rows.documents(spark, sf).unionByName(spark.createDataFrame([(8000 + i, t, None, None, None) for i, t in enumerate(HARD)], rows.DOC_SCHEMA), allowMissingColumns=True)
    expected = Counter()
    for doc_id, text in rows.pairs(docs):
        spans = base_pii(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected[(doc_id, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest())] += 1
    got = pii.scan(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    assert pii.scan(rows.empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("mail john dot doe at example dot com now", "john dot doe at example dot com"),
        ("write j.smith (at) mail [dot] example [dot] org!", "j.smith (at) mail [dot] example [dot] org"),
        ("call plus four nine one five one two three four five six seven", "plus four nine one five one two three four five six seven"),
        ("аlice＠ехаmple．com", "аlice＠ехаmple．com"),
        ("card four one one one 1111 1111 1111.", "four one one one 1111 1111 1111"),
        ("host １92．168.0．1 up", "１92．168.0．1"),
        ("x​@​y.com", "x​@​y.com"),
    ],
)
def test_pii_disguises_keep_offsets(text, span):
    base, added = pii.find(text)
    assert [text[a:b] for _, a, b in base + added] == [span]


@pytest.mark.parametrize(
    "text, base, added",
    [
        ("john at example.com", [], [("email", 0, 19)]),
        ("to john at example d\u043et com now", [], [("email", 3, 26)]),
        ("john at example doT com", [], [("email", 0, 23)]),
        ("\U0001d423\U0001d428\U0001d421\U0001d427@example.com", [], [("email", 0, 16)]),
        ("john dot doe@example.com", [("email", 9, 24)], [("email", 0, 24)]),
        ("john at example [dot] com", [], [("email", 0, 25)]),
        ("john at mail.example dot com", [], [("email", 0, 28)]),
        ("plus 49 30 1234567", [], [("phone", 0, 18)]),
        ("plus four nine Oh one two three four five six seven", [], [("phone", 0, 51)]),
    ],
)
def test_pii_mixed_disguises(text, base, added):
    """Each step sees what those before it wrote; a longer added span may overlap a base one."""
    assert pii.find(text) == (base, added)


@pytest.mark.parametrize("text", ["we met at noon, dot your notes", "one two buckle my shoe", "look at the dot com boom", "rows (at) rest"])
def test_pii_leaves_plain_text(text):
    assert pii.find(text) == ([], []) and pii.redacted(text) == text


def test_pii_redaction():
    assert pii.redacted("to a@b.cd or 10.0.0.1") == "to <EMAIL> or <IP>"


def base_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {i + d for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_quality_measures(spark, sf):
    extra = [(8100, "a b c a b c a b", *[None] * 3), (8101, "x\n\nx\n \nx\r\ny # * $ | < >\n", *[None] * 3), (8102, " ".join(map(str, range(60))), *[None] * 3)]
    docs = rows.documents(spark, sf).unionByName(spark.createDataFrame(extra, rows.DOC_SCHEMA), allowMissingColumns=True)
    got = quality.apply_policy(quality.ledger(docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((d, *base_quality(t)) for d, t in rows.pairs(docs))
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.ledger(rows.empty(spark)).count() == 0


def test_quality_sql_form(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(quality.LEDGER_SQL)
    ours = quality.apply_policy(quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))).select(*rel.columns)
    assert Counter(map(tuple, ours.collect())) == Counter(rel.fetchall())


def test_quality_filter_and_ablation(spark, sf):
    docs = rows.documents(spark, sf)
    ledger = quality.ledger(docs).cache()
    kept = quality.apply_policy(ledger).filter("kept").count()
    assert quality.keep(docs).count() == kept and quality.keep(docs).columns == docs.columns
    masks = [r.failed_bits for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        bit = 1 << quality.RULES[r.rule]
        assert (r.n_rejected, r.n_only_this, r.n_kept_without) == (sum(m & bit > 0 for m in masks), sum(m == bit for m in masks), sum(m & ~bit == 0 for m in masks))


def test_language_mixture(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(known) and len(held) > 200
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    a, b = (next(r.text for r in docs.filter(f"lang = '{x}' and n_chars between 1500 and 3000").orderBy("doc_id").take(1)) for x in ("de", "fr"))
    mixed = spark.createDataFrame([(1, a[:1500] + " " + b[:900]), (2, "123 ###"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.predict(mixed, langid.fit(langid.training_rows(docs))).collect()}
    assert set(out[1].languages.split(",")) == {"de", "fr"} and out[1].lang_pred == "de" and 0.5 < out[1].score < 0.75
    assert (out[2].lang_pred, out[2].score) == ("und", 0.0) and out[3].lang_pred == "und"


def test_language_odd_rows(spark):
    got = langid.identify(rows.documents(spark)).collect()
    assert len(got) == len(rows.ODD) and all(r.lang_pred == "und" for r in got if r.doc_id in (7001, 7002))
    assert langid.identify(rows.empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(rows.documents(spark).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_license_scan_grows_with_the_text(spark):
    """A long text carries its few words to each place, never itself: four times the words take well under eight times as long."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "licensed under the apache license version 2.0 some words more " * (n // 10))], "doc_id long, text string")
        began = time.perf_counter()
        found = licenses.scan(df).collect()
        assert found[0].labels == "apache-2.0" and found[0].n_words == n // 10 * 11
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(50_000), seconds(200_000)
    assert large < 8 * small + 4
