"""Operators that compare texts with each other, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from coinbrook.llm import decontam, jaccard, quality, repeats, toolcalls, warc
from tests.llm import rows


def brute_repeats(pairs, window=repeats.WINDOW):
    count = Counter(b[i : i + window] for _, t in pairs for b in [t.encode()] for i in range(len(b) - window + 1))
    out, owners = Counter(), defaultdict(set)
    for doc_id, t in set(pairs):
        b = t.encode()
        for i in range(len(b) - window + 1):
            owners[b[i : i + window]].add((doc_id, t))
    for doc_id, t in pairs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        other = any(len(owners[b[i : i + window]]) > 1 for i in range(len(b) - window + 1))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out[doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(), other] += 1
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_CONTEXTS, 2])
def test_repeats(spark, sf, hot):
    passage = "".join(chr(97 + i * i % 26) for i in range(600))
    extra = [(9001, "ab" * 900), (9002, "é" * 500), (9003, "x" * 401), (9003, "x" * 401), (9004, "q" * 399), (9005, "start " + passage[:450] + " end"), (9006, passage[50:] + "!"), (9007, passage[:399])]
    extra += [(9008, "own " + passage[::-1] + " twice " + passage[::-1]), (9009, "z" * 500 + passage[7:420]), (9010, passage[::-1][300:] + "z" * 420 + "?" * 700)]
    docs = rows.documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.repeats_elsewhere) for r in repeats.remove(docs, hot).collect())
    assert got == brute_repeats(rows.pairs(docs))


def test_repeats_empty(spark):
    assert repeats.remove(rows.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=24), min_size=1, max_size=40))
def test_multikey_sort(items):
    rows_ = np.array([list(x.ljust(24, b"\0")) for x in items], np.uint8)
    order = repeats.multikey_sort(rows_)
    assert [bytes(r) for r in rows_[order]] == sorted(bytes(r) for r in rows_)
    lcp = repeats.common_prefixes(rows_, order)
    for k in range(1, len(order)):
        a, b = rows_[order[k - 1]], rows_[order[k]]
        assert lcp[k] == next((i for i in range(24) if a[i] != b[i]), 24)


def shingle_set(text):
    w = re.findall(r"\w+", text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent, links = list(range(len(pairs))), [0] * len(pairs)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j > i).items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    none = 1 << 62
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[top(i)] = min(least.get(top(i), none), none if d is None else d)
    return Counter((d, None if least[top(i)] == none else least[top(i)], links[i]) for i, (d, _) in enumerate(pairs))


@pytest.mark.parametrize("bucket", [jaccard.BUCKET, 8])
def test_jaccard_join(spark, sf, bucket):
    base = " ".join(f"word{i}" for i in range(60))
    near = [(10_000 + i, base + f" tail{i}") for i in range(150)] + [(10_500 + i, base.replace(f"word{i}", "changed")) for i in range(30)]
    docs = rows.documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = jaccard.join(docs, bucket=bucket).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows.pairs(docs))


def test_jaccard_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 3000)
    base = [f"word{i}" for i in range(80)]
    near = [(i, " ".join(base[:5] + [f"x{i % 40}"] + base[6:])) for i in range(120)]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs).collect()) == brute_classes(near)


def test_jaccard_empty_and_runs(spark):
    assert jaccard.join(rows.empty(spark)).count() == 0
    assert jaccard.runs_for(0.9, 1) < jaccard.runs_for(0.999, 1) < jaccard.runs_for(0.999, 3)


def brute_leaks(docs, items):
    out = {}
    for item_id, text in items:
        tokens = re.findall(r"\w+", text.lower())
        k = min(5, len(tokens))  # a shorter item is one shingle
        grams = lambda w, k=k: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
        own = Counter(grams(tokens))
        for doc_id, t in docs:
            w = re.findall(r"\w+", t.lower())
            s = grams(w) if w else []
            n = min(own.total(), len(s))
            if not n or not own.keys() & set(s):
                continue
            for start in range(len(s) - n + 1):
                have = Counter(s[start : start + n])
                both = (have & own).total()
                similarity = both / (have.total() + own.total() - both)
                if similarity >= 0.8 and similarity > out.get((doc_id, item_id), (0,))[0]:
                    out[doc_id, item_id] = (similarity, start)
    return out


def test_decontamination(spark, sf):
    item = " ".join(f"term{i}" for i in range(50))
    bench = [(1, item), (2, "Short item here"), (3, None), (4, ""), (5, item)]
    own = [(1, "noise before " + item + " and after"), (2, item.replace("term0", "other").upper()), (3, item.replace("term25", "other").replace("term12", "another")), (4, " ".join(item.split()[:-3])), (5, "a short item here is"), (None, item)]
    docs = rows.documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").withColumn("item_id", jaccard.F.col("item_id") + 100).unionByName(spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontam.contaminated(docs, items).collect()}
    expected = brute_leaks(rows.pairs(docs), [(r.item_id, r.text) for r in items.collect() if r.text])
    assert got == expected and {1, 2, 4, None} <= {d for d, _ in got} and (3, 1) not in got


def test_a_full_filter_loses_nothing(spark, sf):
    docs, items = rows.documents(spark, sf), decontam.item_table(spark.read.parquet(f"{sf}/benchmark.parquet"))
    whole, full = (decontam.windows(docs, decontam.item_filter(items, most)) for most in (decontam.FILTER_BITS, 1 << 12))
    assert whole.exceptAll(full).count() == 0 and full.count() > whole.count() > 0


def test_decontamination_empty(spark, sf):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = rows.documents(spark)
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.contaminated(rows.empty(spark), spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=16, max_size=16), st.sets(st.integers(0, 127), max_size=decontam.RADIUS))
def test_some_block_is_always_near(fp, flips):
    value = int.from_bytes(fp, "big")
    for b in flips:
        value ^= 1 << b
    other = value.to_bytes(16, "big")
    assert any(other[k] in decontam.near_values(fp[k]) for k in range(decontam.BLOCKS))


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    more = [(None, None, None), (5, None, None), (5, None, None), (99_001, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 3"), (99_000, "v\r\nx", "WARC/1.1\r\n\r\n\r\nContent-Length: 3"), (99_002, "w", "é\x00\r\n\r\n")]
    pages = pages.unionByName(spark.createDataFrame(more, pages.schema)).withColumn("record_type", warc.F.lit("clash"))
    first, expected = {}, Counter()
    order = sorted(((r.page_id is None, r.page_id, (r.html or "").encode()) for r in pages.collect()), key=lambda x: (x[0], x[1] or 0))
    import base64

    for _, page, data in order:
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected[page, len(data), digest, "revisit" if digest in first else "response", first.get(digest)] += 1
        first.setdefault(digest, page)
    got = warc.deduplicated(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert warc.deduplicated(pages.limit(0)).count() == 0


def test_warc_large_payloads_have_files_of_their_own(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", ((0, 2), (10, 1)))
    pages = spark.createDataFrame([(i, "u", "x" * n) for i, n in enumerate((1, 2, 3, 4, 30, 40, 30))], "page_id long, url string, html string").coalesce(1)
    got = warc.deduplicated(pages, str(tmp_path / "w")).collect()
    assert Counter((r.page_id, r.payload_bytes, r.refers_to) for r in got) == Counter([(0, 1, None), (1, 2, None), (2, 3, None), (3, 4, None), (4, 30, None), (5, 40, None), (6, 30, 4)])
    records = warc.read_archives(spark, str(tmp_path / "w")).select("*", warc.F.col("page_id"))
    per_file = Counter(len(list(warc.parse_records(__import__("gzip").open(f)))) for f in (tmp_path / "w").glob("*.gz"))
    assert records.count() == 7 and max(per_file) <= 2 and per_file[1] >= 3


def test_warc_files_and_sql_form(spark, sf, tmp_path):
    import duckdb

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.deduplicated(pages.unionByName(pages.withColumn("page_id", warc.F.col("page_id") + 10_000)), str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    bodies = {r.page_id: bytes(r.payload) for r in records if r.record_type == "response"}
    assert bodies == {r.page_id: r.html.encode() for r in pages.collect()}
    assert all(r.refers_to_record and not r.payload for r in records if r.record_type == "revisit")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rel = con.sql(warc.PAGES_SQL)
    assert Counter(map(tuple, warc.deduplicated(pages).select(*rel.columns).collect())) == Counter(rel.fetchall())
    assert warc.resolve(warc.headers(pages.unionByName(pages)).drop("html"), min_bytes=1 << 30).filter("record_type = 'revisit'").count() == 0


def test_tool_calls(spark):
    turns = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":{"$ref":"b"}}},{"id":"b","name":"f","arguments":"{\\"y\\": 1}"},{"id":"b","name":"f","arguments":{}}]}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":[1, {"z":2,"a":"é"}]}'),
        (1, 3, "tool", '{"tool_call_id":"zz","content":null}'),
        (2, 1, "assistant", '{"tool_calls":[{"id":"c","name":"f","arguments":{"x":{"$ref":"d"}}},{"id":"d","name":"g","arguments":{"x":{"$ref":"c"}}}]}'),
        (None, None, None, None),
        (3, 0, "user", ""),
        (3, 0, "user", ""),
        (3, 1, "assistant", "ok"),
        (4, 1, "assistant", "{broken"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("level", toolcalls.F.lit("clash"))
    schemas = {"f": {"type": "object", "properties": {"y": {"type": "string"}}}, "reply": toolcalls.SCHEMAS["reply"]}
    got = {(r.conv_id, r.call_id, r.status): r for r in toolcalls.link(toolcalls.parse(df, schemas)).collect()}
    assert set(got) == {(1, "1:0", "open"), (1, "a", "linked"), (1, "b", "open"), (1, "b", "duplicate"), (1, "zz", "orphan"), (2, "c", "cycle"), (2, "d", "cycle"), (3, "3:0", "linked"), (3, "3:0", "duplicate"), (4, "4:0", "orphan")}
    a, b = got[1, "a", "linked"], got[1, "b", "duplicate"]
    assert a.level == 1 and a.canonical == '{"arguments":{"x":{"$ref":"b"}},"id":"a","name":"f","result":[1,{"a":"é","z":2}]}'
    assert got[1, "b", "open"].level == 0 and got[1, "b", "open"].problems == ["$.y: not of type string"] and b.valid
    assert got[2, "d", "cycle"].problems == ["$: unknown tool"] and not got[3, "3:0", "linked"].valid
    assert toolcalls.tool_links(df.limit(0)).count() == 0


def test_tool_links_cover_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = {(r.conv_id, r.turn): r.role for r in df.collect()}
    got = toolcalls.tool_links(df).collect()
    calls = {(c, t) for (c, t), role in turns.items() if role == "user"}
    assert {(r.conv_id, r.turn) for r in got if r.turn is not None} == calls
    assert {(r.conv_id, r.turn) for r in got if r.status == "linked"} == {(c, t) for c, t in calls if turns.get((c, t + 1)) == "assistant"}


def test_tool_links_sql_form(spark, sf):
    import duckdb

    from coinbrook.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(toolcalls.PLAIN_TURNS_SQL)
    assert Counter(map(tuple, queries.op7_tool_calls(spark, sf).select(*rel.columns).collect())) == Counter(rel.fetchall())


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage against what its operator says about its own input."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = " ".join(f"w{i}" for i in range(80))
    own = [(50_001, clean, "en", "s", 1), (50_000, clean + " more", "en", "s", 1), (50_002, " ".join(f"v{i}" for i in range(80)) + " " + item, "en", "s", 1), (50_003, "mail me@x.org " + " ".join(f"u{i}" for i in range(80)), "en", "s", 1)]
    docs = rows.documents(spark, sf).unionByName(spark.createDataFrame(own, rows.DOC_SCHEMA), allowMissingColumns=True)
    at = docs
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(at)
    assert all(set(x.columns) == set(corpus_pipeline.COLUMNS) for x in kept[:-1])
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in kept]
    verdict = quality.apply_policy(quality.ledger(docs))
    assert Counter(ids[0]) == Counter(r.doc_id for r in verdict.filter("kept").collect())
    classes = brute_classes(rows.pairs(kept[0]))
    assert sorted(x or -1 for x in ids[1]) == sorted({c or -1 for _, c, _ in classes})
    assert 50_000 in ids[1] and 50_001 not in ids[1]
    leaks = {d for d, _ in brute_leaks(rows.pairs(kept[1]), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    assert 50_002 in leaks and Counter(ids[2]) == Counter(x for x in ids[1] if x not in leaks)
    assert ids[3] == ids[2] and {r.doc_id: r.text for r in kept[3].collect()}[50_003].startswith("mail <EMAIL> u0")
    assert Counter(ids[4]) == Counter(ids[3])
    for (_, stage), x in zip(corpus_pipeline.STAGES, kept, strict=True):
        none = stage(spark, rows.empty(spark), sf)
        assert none.count() == 0 and none.columns == x.columns
