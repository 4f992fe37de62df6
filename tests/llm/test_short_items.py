"""Items of fewer words than a window, with repeated words and ties, against brute force."""

import hashlib
import random

import pytest

from spanloom.llm.decontaminate import contamination


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 9}, {"block_rows": 9, "scans": 0}])
def test_short_and_repeating_items_against_brute_force(spark, blocks):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(f"i{k}", text(n)) for k, n in enumerate([1, 4, 4, 7, 12, 13, 20, 0])]
    docs = [(k, text(r.randint(0, 60))) for k in range(40)] + [(99, None), (98, "a b c a b"), (98, "a b c a b")]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), **blocks)
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in found.collect()}
    for doc, t in docs:
        w, hit, held = (t or "").split(), set(), set()
        for item, x in items:
            y = x.split()
            n = min(13, len(y))
            for a in range(len(y) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == y[a : a + n]:
                        hit |= set(range(p, p + n))
                        held.add(item)
        assert got[doc] == (len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest())
