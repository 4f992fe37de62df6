"""Language identification: held-out accuracy, rejection, edges."""

import random
import zlib

from spanloom.llm.langid import Languages, language_id, letters

SCHEMA = "doc_id long, text string, lang string, score double, source string"
SOUNDS = {"aa": "ba lo mi nu ser tan vie qua ont".split(), "bb": "kra zto gwi plu hek jod fri umt yas".split(), "cc": "shai noru timo kesu wani hobe reku yomi dato".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    lexicon = {k: ["".join(r.choices(v, k=r.randint(1, 3))) for _ in range(150)] for k, v in SOUNDS.items()}
    rows = []
    for i in range(n):
        lang = r.choice(list(lexicon))
        rows.append((i, " ".join(r.choices(lexicon[lang], k=r.choice([4, 12, 60]))).capitalize() + ".", lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "s") for r in rows], SCHEMA).repartition(3)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_held_out_labels_teach_nothing(spark):
    rows = corpus(400)
    got = {r.doc_id: r for r in language_id(table(spark, rows)).collect()}
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    test = [(i, lang) for i, _, lang in rows if held(i)]
    assert sum(got[i].lang_pred == lang for i, lang in test) >= 0.97 * len(test)
    changed = [(i, t, "aa" if held(i) else lang) for i, t, lang in rows]
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id(table(spark, changed)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_sizes_are_of_whole_texts_and_narrow_margins_are_rejected(spark):
    rows = corpus(300)
    text = {k: next(t for _, t, lang in rows if lang == k and len(t) > 200) for k in SOUNDS}
    mixed, long = text["aa"] + " " + text["bb"], text["aa"] + " " + " ".join([text["cc"]] * 40)  # what comes after the first words decides
    more = [(1001, mixed, None), (1002, "xq", None), (1003, long, None), (1004, text["bb"], None)]
    got = {r.doc_id: r for r in language_id(table(spark, rows + more), margin=0.2).collect()}
    assert got[1001].rejected and got[1002].rejected and got[1002].score == 0
    assert got[1003].lang_pred == "cc" and (got[1004].lang_pred, got[1004].rejected) == ("bb", False)
    model = Languages().fit(table(spark, rows))
    assert model.sizes("Ba lo, ba LO!", model.compressors()) == model.sizes("ba lo ba lo", model.compressors())


def test_edges(spark):
    nothing = table(spark, [])
    assert language_id(nothing).collect() == []
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "123 ... 4_5", "bb"), (4, "ñ", None), (None, "ba lo mi", "aa"), (None, "ba lo mi", "aa"), (6, "ba " * 40000, "aa")]
    got = sorted(((r.doc_id or 0, r.lang_pred, r.rejected) for r in language_id(table(spark, rows)).collect()))
    assert got == [(0, "aa", False), (0, "aa", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False), (6, "aa", False)]
    untaught = language_id(table(spark, [(4, "ñ", None), (5, "ba lo", None)])).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in untaught} == {("und", 0.0, True)}
    assert letters("Été 3 c_d'E!") == " été c d e "


def test_copies_dont_fill_the_sample(spark):
    rows = corpus(200) + [(1000 + i, "ba lo mi nu", "aa") for i in range(3000)]
    small = Languages(most_docs=60).fit(table(spark, rows))
    assert set(small.content) >= {"bb", "cc"} and all(len(c) < 16_002 for c in small.content.values())
