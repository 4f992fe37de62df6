"""Operators against brute force on small tables, where SQL has no word for them."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter

import pytest

from spanloom.llm.license_texts import BASE, PASSAGES
from spanloom.llm.licenses import scan_licenses
from spanloom.llm.mixing import mix
from spanloom.llm.sharding import shard
from spanloom.llm.sketch import Sketch
from spanloom.llm import spotsigs
from spanloom.llm.spotsigs import ANCHORS, fingerprints, near_classes, near_pairs
from spanloom.llm.substring import remove_repeated_windows
from spanloom.llm.suffixes import remove_repeated_bytes
from spanloom.llm.toxicity import toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def table(spark, texts, partitions=4):
    return spark.createDataFrame(list(texts), "doc_id long, text string").repartition(partitions)


def corpus(seed, n=60, passages=6):
    """Texts that share passages, words around them, lines of white space of many kinds, bytes of several in a character."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["é", "漢字", "ü" * 30, "a", "b"]
    shared = [" ".join(r.choices(words, k=r.randint(15, 60))) for _ in range(passages)]
    texts = []
    for i in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 40))) if r.random() < 0.6 else r.choice(shared) for _ in range(r.randint(0, 6))]
        texts.append((i * 7 % 101, r.choice([" ", "\n", "  ", "\t "]).join(parts)))
    return [*texts, (200, None), (201, ""), (202, texts[3][1]), (203, texts[3][1]), (204, "x" * 400), (205, "y " * 90 + "x" * 120)]


def test_license_places_and_labels(spark):
    r, phrases = random.Random(5), [*BASE, "mit", "license", "general public", "Apache  LICENSE", "mit-license", "MIT\nLicense,", "the", "word", "é"]
    docs = [(k, " ".join(r.choices(phrases, k=r.randint(0, 25)))) for k in range(80)]
    for x in scan_licenses(table(spark, docs)).collect():
        w = WORD.findall(fold(dict(docs)[x.doc_id]))
        at = sorted((i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        first, last = (at[0][0], at[-1][0]) if at else (None, None)
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), first, last, ",".join(sorted({v for _, v in at})))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""} and x.score == (1.0 if x.labels else 0.0)


def test_the_longest_phrase_at_a_place_gives_its_label(spark):
    docs = [(1, "Under CC BY-NC only"), (2, "cc by, then CC-BY-SA"), (3, "cc by nc and elsewhere cc by"), (4, "the Lesser General Public License"), (5, "cc by n"), (6, "cc by cc by nc")]
    got = {x.doc_id: x for x in scan_licenses(table(spark, docs)).collect()}
    assert {i: x.labels for i, x in got.items()} == {1: "cc-by-nc", 2: "cc-by,cc-by-sa", 3: "cc-by,cc-by-nc", 4: "gpl,lgpl", 5: "cc-by", 6: "cc-by,cc-by-nc"}
    assert got[4].base_labels == "gpl" and (got[4].first_word, got[4].n_base) == (2, 1)
    assert [(s.template, s.first_word, s.last_word) for s in got[6].spans] == [("phrase:cc by", 0, 1), ("phrase:cc by nc", 2, 4)]


def test_license_texts_are_found_whole_changed_and_not_in_pieces(spark):
    texts = {f"{label} {name}": text for label, name, text in PASSAGES}
    mit = texts["mit text"].split()
    changed = [w for k, w in enumerate(mit) if k not in (40, 90)]
    changed[20:20] = ["quite"]
    docs = [(k, f"intro {text} outro") for k, text in enumerate(texts.values())] + [(100, " ".join(changed)), (101, " ".join(mit[:25])), (102, " ".join(reversed(mit)))]
    got = {x.doc_id: x for x in scan_licenses(table(spark, docs)).collect()}
    for k, name in enumerate(texts):
        assert name.split()[0] in got[k].labels.split(",") and got[k].score == 1.0
        spans = {s.template: s for s in got[k].spans}
        assert spans[f"passage:{name}"].first_word == 1 and spans[f"passage:{name}"].share == 1.0
    assert "mit" in got[100].labels.split(",") and 0.6 <= max(s.share for s in got[100].spans if s.template == "passage:mit text") < 1
    assert got[101].labels == "" and got[102].labels == ""


@pytest.mark.parametrize("hot", [1 << 20, 1])
def test_bytes_against_brute_force(spark, hot):
    docs = corpus(1)
    least = 50
    starts = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            s = b[k : k + least]
            starts[s] = min(starts.get(s, i), i)
    got = {x.doc_id: x for x in remove_repeated_bytes(table(spark, docs), least, with_bytes=True, hot=hot).collect()}
    removed = 0
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - least + 1):
            if starts[b[k : k + least]] < i:
                gone[k : k + least] = [True] * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, got[i].kept) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
        removed += sum(gone)
    assert removed > 2000


@pytest.mark.parametrize("seed", [2, 3])
def test_windows_against_brute_force(spark, seed):
    docs, n = corpus(seed), 20
    first = {}
    for i, t in sorted(docs):
        w = PLAIN.findall(t or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    got = {x.doc_id: x for x in remove_repeated_windows(table(spark, docs), n, with_text=True).collect()}
    for i, t in docs:
        w = PLAIN.findall(t or "")
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] != (i, k) for p in range(k, k + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text, got[i].kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("bits,shards", [(24, 1 << 16), (10, 4), (8, 2)])
def test_sketch_overestimates_and_knows_hot_keys(bits, shards):
    """However it is cut into shards and slices: no key of two chunks is missed, and no hot one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    r = np.random.default_rng(1)
    chunks = [r.integers(0, 1 << 62, 500, np.uint64) for _ in range(6)]
    chunks = [np.concatenate([c, np.repeat(np.uint64(99), 9), np.full(int(k > 2), 77, np.uint64)]) for k, c in enumerate(chunks)]
    s = Sketch(3000, shard_bits=bits, shards=shards, weigh=True, hot=50)
    told = pa.concat_tables([s.report(k, c) for k, c in enumerate(chunks)])
    answers = {k: {} for k in range(6)}
    for key in set(told["k"].to_pylist()):
        for row in s.merge(told.filter(pa.compute.equal(told["k"], key))).to_pylist():
            answers[row["g"]][row["k"]] = row["answer"]
    for k, c in enumerate(chunks):
        maybe, hot = s.repeated(c, answers[k])
        assert maybe[c == 99].all() and hot[c == 99].all() and maybe[c == 77].all() and not hot[c == 77].any()
        assert maybe[:500].mean() < 0.2 and not hot[:500].any()


def signatures(text):
    w = WORD.findall(fold(text))
    common = set(ANCHORS)
    chains = [(x, *[y for y in w[i + 1 : i + 13] if y not in common][:3]) for i, x in enumerate(w) if x in common]
    found = {c for c in chains if len(c) > 1}
    return found or ({("", *w)} if w else ({("", text)} if text else set()))


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_brute_force(spark):
    r = random.Random(4)
    words = ["the", "of", "and", "a", "der", "la", "Haus", "river", "stone", "É", "x1", "42"]
    docs = [(3 * k, " ".join(r.choices(words, k=r.randint(0, 40)))) for k in range(300)] + [(1, None), (2, "..."), (4, "the of and"), (5, "ü" * 7)]
    got = {x.doc_id: x for x in fingerprints(table(spark, docs)).collect()}
    order = sorted(docs, key=lambda x: -x[0])
    prints = {}
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(x.near_edited - like(signatures(t), signatures(edited))) < 1e-9 and abs(x.near_next - like(signatures(t), signatures(after))) < 1e-9
        bare = sum(k[0] == "" for k in signatures(t))  # has twice the bits
        assert len(x.fingerprint) == 16 * (len(signatures(t)) + bare) and prints.setdefault(frozenset(signatures(t)), x.fingerprint) == x.fingerprint


@pytest.mark.parametrize("ids", ["dense", "spread", "clustered", "one", "none"])
def test_the_next_document_whatever_the_ids(spark, ids, monkeypatch):
    """Ids that are sparse, that crowd, that a third of the rows share, or that many rows lack; small runs and few ranges."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(spotsigs, "RUN", 4)
    monkeypatch.setattr(spotsigs, "RANGES", 16)
    r = random.Random(8)
    of = {"dense": lambda k: k, "spread": lambda k: r.randint(-(2**62), 2**62), "clustered": lambda k: 10**15 * (k % 3) + k, "one": lambda k: 7 if k % 3 == 0 else r.randint(0, 20), "none": lambda k: None if k % 3 == 0 else k}[ids]
    docs = [(of(k), f"text {r.random()} {k}") for k in range(240)]
    order = [tuple(x) for x in table(spark, docs).orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()).collect()]
    want = sorted((i is None, i or 0, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True))
    got = fingerprints(table(spark, docs))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.edited_sha256) for x in got.collect()) == want
    assert spotsigs._next_bucket(table(spark, docs).select("doc_id", F.xxhash64("text").alias("row")).select(spotsigs._bucket(240, sorted(i for i, _ in docs if i is not None)[:: 240 // 16]).alias("b")).distinct()).count() >= 20


def test_different_texts_without_anchors_have_different_fingerprints(spark):
    """So many that hashes of 32 bits would let some collide."""
    df = spark.range(150_000).selectExpr("id as doc_id", "concat('слово', id) as text")
    assert fingerprints(df).select("fingerprint").distinct().count() == 150_000


def test_near_fingerprints_against_brute_force(spark):
    """Classes of texts that share much, a passage that all share, exact copies, and short sets."""
    r, docs = random.Random(6), []
    every = " ".join(f"the c{k} of d{k}" for k in range(30))
    for g in range(25):
        base = [f"the {r.choice('abcdefgh')}{r.randint(0, 30)} of x{g}y{k}" for k in range(r.choice([1, 4, 30]))]
        for v in range(4):
            own = [x if r.random() > 0.05 else f"the new{v} of n{g}y{k}" for k, x in enumerate(base)]
            docs.append((10 * g + v, " . ".join([every] * (g % 3 == 0) + own)))
        docs.append((10 * g + 5, docs[-1][1]))
    docs += [(901, None), (902, ""), (903, "plain words"), (904, "Plain WORDS")]
    sets = {i: frozenset(signatures(t or "")) for i, t in docs}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    pairs, members = near_pairs(table(spark, docs))
    assert {x.doc_id: x.class_id for x in members.collect()} == {i: first[s] for i, s in sets.items()}
    reps = [s for s in first if s]
    want = {(first[a], first[b]) for a in reps for b in reps if first[a] < first[b] and like(a, b) >= 0.8}
    assert {(x.a, x.b) for x in pairs.collect()} == want and len(want) > 20
    links = Counter(c for p in want for c in p)
    assert {x.doc_id: x.n_links for x in near_classes(table(spark, docs)).collect()} == {i: links[first[s]] for i, s in sets.items()}


@pytest.mark.parametrize("common", [0, 3, 1 << 20])
def test_near_classes_shuffle_sets_once_whatever_is_known_to_be_common(spark, common, monkeypatch):
    """Documents meet their classes, and classes their rarest signatures, without a shuffle of whole sets by the set."""
    monkeypatch.setattr(spotsigs, "COMMON", common, raising=False)
    r = random.Random(9)
    docs = [(k, " . ".join(["the start of all"] + [f"the c{r.randint(0, 3) if r.random() < 0.02 else j} of g{k % 12}y{j}" for j in range(40)])) for k in range(72)]
    sets = {i: frozenset(signatures(t)) for i, t in docs}
    first = {}
    for i, x in sorted(sets.items()):
        first.setdefault(x, i)
    pairs, members = near_pairs(table(spark, docs))
    want = {(first[a], first[b]) for a in first for b in first if first[a] < first[b] and like(a, b) >= 0.8}
    assert sorted((x.a, x.b) for x in pairs.collect()) == sorted(want) and want
    assert {x.doc_id: x.class_id for x in members.collect()} == {i: first[x] for i, x in sets.items()}
    assert "hashpartitioning(sigs" not in members._jdf.queryExecution().toString()


def insults(n, seed, toxic_share=0.3):
    r = random.Random(seed)
    plain, vile = [f"word{k}" for k in range(200)], [f"vile{k}" for k in range(12)]
    docs, labels = [], []
    for i in range(n):
        lang, bad = r.choice(["en", "en", "fr"]), r.random() < toxic_share
        w = r.choices(plain, k=r.randint(5, 60))
        for _ in range(r.randint(3, 5) if bad else r.random() < 0.2):
            w.insert(r.randint(0, len(w)), r.choice(vile))
        docs.append((i, " ".join(w), lang))
        labels.append((i, 1, int(bad)))
    return docs, labels


def held(i):
    return binascii.crc32(str(i).encode()) % 4 == 2


def test_toxicity_learns_and_leaves_held_out_labels_alone(spark):
    docs, labels = insults(1600, 7)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    run = lambda ls: {x.doc_id: x for x in toxicity(d, spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect()}
    got = run(labels)
    truth = {i: t for i, _, t in labels}
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3) for i in truth)
    bad, good = ([got[i].score for i in truth if held(i) and truth[i] == k] for k in (1, 0))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.97
    assert {x.lang_threshold for i, x in got.items() if docs[i][2] == "en"} != {x.lang_threshold for i, x in got.items() if docs[i][2] == "fr"}  # calibrated by language
    turned = run([(i, q, 1 - t if held(i) else t) for i, q, t in labels])
    assert all(turned[i].score == got[i].score for i in truth)


def test_toxicity_bounds_what_it_fits_on(spark):
    docs, labels = insults(120, 8)
    docs = [*docs, *[(i, t, lang) for i, t, lang in docs[:40]], *[(5, "another text of the same document", "en")] * 3]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumnsRenamed({"lang": "score"}).selectExpr("*", "score as _score", "1 as __score", "2 as ___score", "score as lang")
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len(toxicity(d, ls, max_train=30, max_words=400).collect()) == len(docs)
    from spanloom.llm.toxicity import Toxicity

    assert Toxicity(max_words=0).fit(d, ls).score(d).columns[-1] == "____score"


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """The toxic ones all come after the first 5,000 by the hash that a bounded fit goes by."""
    from pyspark.sql import functions as F

    from spanloom.llm import toxicity as module

    monkeypatch.setattr(module, "PART_ROWS", 2000, raising=False)
    order = [x.doc_id for x in spark.range(7600).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id")).collect() if not held(x.doc_id)]
    late = set(order[5000:][::2])
    docs = [(i, f"word{i % 50} " + ("vile" if i in late else "mild") + f" word{i % 7}", "en") for i in range(7600)]
    labels = spark.createDataFrame([(i, 1, int(i in late)) for i, *_ in docs], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = module.Toxicity().fit(d, labels)
    got = {x.doc_id: x.score for x in model.score(d).collect()}
    assert min(got[i] for i in late) > max(s for i, s in got.items() if i not in late)
    assert model.fitted == len(order) > 5000


def test_toxicity_fits_parts_in_rounds(spark, monkeypatch):
    from spanloom.llm import toxicity as module

    monkeypatch.setattr(module, "PART_ROWS", 300)
    docs, labels = insults(1600, 7)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = [{x.doc_id: x.score for x in toxicity(d.repartition(k), ls).collect()} for k in (1, 7)]
    assert all(abs(runs[0][i] - runs[1][i]) < 1e-5 for i, *_ in docs)
    bad, good = ([runs[0][i] for i, _, t in labels if held(i) and t == k] for k in (1, 0))
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good)) > 0.9


def test_mix_against_brute_force(spark):
    """Targets by filling up one source after the other; sizes, bounds and sums of what is taken, with a hot source and ties."""
    r = random.Random(9)
    docs = [(i, "w " * r.randint(0, 30), r.choice(["a", "a", "a", "b", "c", None, "z" * 3])) for i in range(900)] + [(1, "one two", "b"), (1, "one two", "b")]
    quality = spark.createDataFrame([(i, r.choice([0.25, 1.0, 4.0])) for i in range(0, 900, 2)], "doc_id long, weight double")
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(d, quality).collect()
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * size[s]]
        for s in full or list(open_):
            target[s] = 3.0 * size[s] if full else share * weight[s]
        open_ -= set(full) or set(open_)
        left -= sum(target[s] for s in full)
    taken = Counter()
    for x in got:
        assert x.source_size == size[x.source] and abs(x.target - target[x.source]) < 1e-6 and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(tuple, mix(d.repartition(3), quality).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    one = [x for x in got if x.source == "a"]
    whole = max(math.floor(target["a"] / size["a"] + 1e-9), 0)
    assert all(x.taken >= whole * x.size for x in one)


def test_shards_against_brute_force(spark):
    docs = [(i % 50, "é" * (i % 37)) for i in range(700)] + [(None, None), (None, "x"), (3, None)]
    got = shard(table(spark, docs), 8).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 1, binascii.crc32((t or "").encode())) for i, t in docs)
    load, count = Counter(), Counter()
    for x in got:
        load[x.shard] += x.size
        count[x.shard] += 1
    assert all(sorted(x.slot for x in got if x.shard == k) == list(range(count[k])) for k in range(8))
    slots = Counter()
    for x in got:
        slots[x.vslot] += x.size
    assert max(load.values()) - min(load.values()) <= max(slots.values()) and {x.law for x in got} == {"bytes"}
