"""Words of passages that two documents have, against brute force; shorter than the bytes that are removed."""

import random
from collections import Counter, defaultdict

import pytest

from coinbrook.llm import repeats
from tests.llm import rows


def brute(pairs, n=51):
    owners = defaultdict(set)
    split = {(d, t): t.lower().encode().split() for d, t in pairs}
    for key, w in split.items():
        for i in range(len(w) - n + 1):
            owners[tuple(w[i : i + n])].add(key)
    out = Counter()
    for d, t in pairs:
        w, shared = split[d, t], set()
        for i in range(len(w) - n + 1):
            if len(owners[tuple(w[i : i + n])]) > 1:
                shared.update(range(i, i + n))
        out[d, len(shared)] += 1
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_CONTEXTS, 2])
def test_shared_words(spark, sf, hot):
    draw = random.Random(5)
    words = lambda n: [draw.choice("abcdefghij") + draw.choice("xyzé") + draw.choice("klmn") for _ in range(n)]
    p, q, r = words(51), words(50), words(120)
    text = lambda *parts: " ".join(w for part in parts for w in part)
    extra = [(9101, text(words(40), p, words(70))), (9102, text(words(9), p).upper().replace(" ", "\n")), (9103, text(p, words(2)).replace(" ", " \t ")), (9104, text(q, words(60))), (9105, text(words(60), q))]
    extra += [(9106, text(r, words(5), r)), (9107, text(words(20), r[:80])), (9108, text(r[30:100], words(30))), (9109, text(words(90), q[:25], words(90))), (9110, text(p + p, words(3)))]
    own = words(70)
    extra += [(9111, text(own, words(8), own)), (9112, text(words(51))), (9112, text(p[1:], words(51))), (None, text(r[10:70]))]
    docs = rows.documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {}
    counted = Counter()
    for row in repeats.remove(docs, hot).collect():
        counted[row.doc_id, row.n_shared_words] += 1
        got[row.doc_id] = (row.n_removed, row.n_shared_words)
    assert counted == brute(rows.pairs(docs))
    # 51 words of 204 bytes: nothing to remove, and yet shared.
    assert got[9101] == got[9103] == (0, 51) and got[9104] == got[9105] == (0, 0)
    # What one document repeats by itself is not shared.
    assert got[9111][1] == 0
