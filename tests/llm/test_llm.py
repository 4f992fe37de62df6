"""Edge cases of every training-data operator, and brute force where SQL cannot say it."""

import hashlib
import random
import re

import pytest

from spanloom.llm.chat import escape, format_conversations, read_back, unescape
from spanloom.llm.chosenpath import NearCopies
from spanloom.llm.decontaminate import contamination
from spanloom.llm.licenses import scan_licenses
from spanloom.llm.mixing import mix
from spanloom.llm.sharding import first_map, grown_map, load_map, save_map, shard, sized, slot_table
from spanloom.llm.spotsigs import fingerprints
from spanloom.llm.substring import remove_repeated_windows
from spanloom.llm.suffixes import remove_repeated_bytes
from spanloom.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, row long, score double, n_words string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
TEXTS = [(1, "The mit license and MIT License, of course."), (2, None), (3, ""), (4, "  \t "), (5, LONG), (6, LONG), (6, LONG), (None, LONG), (None, None), (7, "é É ü — 漢字 <turn> \\ end")]


def edge(spark):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", 1, 0.5, "x") for i, t in TEXTS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string")


RUN = {
    "licenses": lambda s, d: scan_licenses(d),
    "toxicity": lambda s, d: toxicity(d, labels(s, [(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1)])),
    "contamination": lambda s, d: contamination(d, bench(s, [(1, "mit license"), (2, None), (None, LONG[:400]), (3, LONG[:400])])),
    "fingerprints": lambda s, d: fingerprints(d),
    "near": lambda s, d: NearCopies().run(d),
    "bytes": lambda s, d: remove_repeated_bytes(d),
    "mix": lambda s, d: mix(d),
    "shard": lambda s, d: shard(d),
    "windows": lambda s, d: remove_repeated_windows(d),
}


@pytest.mark.parametrize("name", sorted(RUN))
def test_edges_and_empty_tables(spark, name):
    got = RUN[name](spark, edge(spark)).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in TEXTS)
    assert RUN[name](spark, empty(spark)).collect() == []


def test_results_on_edges(spark):
    d = edge(spark)
    r = {x.doc_id: x for x in scan_licenses(d).collect()}
    assert (r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (2, 1, 4, "mit") and r[3].n_words == 0
    r = {x.doc_id: x for x in remove_repeated_windows(d).collect()}
    assert r[6].n_removed == r[6].n_words == 30000 and r[None].n_removed == 0
    r = {x.doc_id: x for x in remove_repeated_bytes(d).collect()}
    assert r[5].n_removed == 0 and r[6].n_removed == r[6].n_bytes and r[6].n_spans == 1
    r = {x.doc_id: x for x in NearCopies().run(d).collect()}
    assert r[6].component_id == 5 and not r[6].kept and r[3].component_id == 3
    r = {x.doc_id: x for x in contamination(d, bench(spark, [(1, "mit license")])).collect()}
    assert r[1].n_hit == 4 and r[1].contaminated and not r[5].contaminated
    parts = shard(d).collect()
    assert all(sorted(x.slot for x in parts if x.shard == k) == list(range(sum(x.shard == k for x in parts))) for k in range(8))


def test_a_grown_map_moves_slots_only_into_the_new_shard(spark):
    old = first_map(slot_table(sized(edge(spark))), 3)
    new = {r.vslot: (r.shard, r.version) for r in grown_map(old, 3).collect()}
    assert all(new[r.vslot][1] == 2 and new[r.vslot][0] in (r.shard, 3) for r in old.collect())


def test_maps_are_stored_grown_and_followed(spark, tmp_path):
    """An edited map is a further version; rows that it doesn't move keep their shard, the others go to the new one."""
    d = spark.range(500).selectExpr("id as doc_id", "repeat('x', cast(id % 90 as int)) as text")
    path = f"{tmp_path}/maps"
    save_map(first_map(slot_table(sized(d)), 3), path)
    before = {r.doc_id: (r.shard, r.version) for r in shard(d, 3, maps=path).collect()}
    save_map(grown_map(load_map(spark, path), 3), path)
    after = {r.doc_id: (r.shard, r.version) for r in shard(d, 4, maps=path).collect()}
    with pytest.raises(Exception, match="already exists"):
        save_map(load_map(spark, path, 1), path)
    assert {v for _, v in before.values()} == {1} and {v for _, v in after.values()} == {2}
    moved = [i for i in before if before[i][0] != after[i][0]]
    assert moved and all(after[i][0] == 3 for i in moved)
    assert load_map(spark, path, 1).filter("shard = 3").isEmpty()
    size = [sum(i % 90 + 1 for i in after if after[i][0] == k) for k in range(4)]
    assert max(size) - min(size) < 400


@pytest.mark.parametrize("budget,history", [(60, 20), (5, 0), (10_000, 50)])
def test_chat_round_trip(spark, budget, history):
    nasty = "\\### Assistant: </turn> ok\n<turn user>\n\\l"
    rows = [(1, k, ["system", "user", "assistant"][min(k, 1 + k % 2)], f"{nasty} {k}" if k % 3 else None) for k in range(40)]
    rows += [(None, 0, "assistant", "x"), (2, 0, "a>\nb", ""), (2, None, None, "y")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("window", __import__("pyspark").sql.functions.lit(1))
    got = {r.conv_id: r for r in read_back(format_conversations(t, budget, history)).collect()}
    own = [r for r in rows if r[0] == 1]
    turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)
    loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert got[1].n_turns == 40 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[None].loss_chars == 1 and got[2].n_turns == 2
    assert unescape(escape(nasty, True)) == nasty and "<" not in escape(nasty)


def test_no_conversations_give_no_windows(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    windows = format_conversations(none)
    assert windows.collect() == [] and read_back(windows).collect() == []


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (i % 50 + 1), "en", f"s{i % 4}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(d).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(d.repartition(3)).collect()))
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1 and all(r.taken <= 3 * r.size for r in own)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6


def linked(rows, n, num, den):
    """Brute force: the smallest doc_id that links of n-word shingle sets reach."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    comp, ids = {i: i for i in sets}, sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while any(comp[a] != comp[b] for a, b in near):
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def boilerplate(seed, groups=30):
    """Documents of one common passage and an end of their own, in pairs that differ in a word: alike enough to share
    many minwise tokens with all, near copies only in pairs."""
    r, rows = random.Random(seed), []
    common = [f"c{seed}x{k}" for k in range(90)]
    for g in range(groups):
        own = [f"g{g}x{k}" for k in range(r.randint(20, 40))]
        rows += [(10_000 * seed + 2 * g, " ".join(common + own)), (10_000 * seed + 2 * g + 1, " ".join(common + own + ["end"] * r.randint(1, 2)))]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_no_link_is_lost_in_large_nodes(spark, levels):
    rows = [x for seed in range(7 * levels, 7 * levels + 7) for x in boilerplate(seed)]
    got = NearCopies(3, 85, 100, leaf=3, levels=levels).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = linked(rows, 3, 85, 100)
    wrong = [r.doc_id for r in got if want[r.doc_id] != r.component_id]
    assert len(got) == len(rows) and len(set(want.values())) < len(rows) and not wrong


def test_a_large_group_of_near_copies_isnt_repeated_by_branching(spark):
    """300 different near copies, and pairs apart from them: rows of nodes stay in proportion to documents."""
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base[: k + 50], f"own{k}", *base[k + 50 :]])) for k in range(300)]
    rows += [(1000 + k, " ".join(f"x{k // 2}y{j}" for j in range(60 + k % 2))) for k in range(40)]
    near = NearCopies(3, 85, 100, leaf=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = near.sketches(docs).withColumnRenamed("doc_id", "id")
    nodes, dense = near.nodes(classes)
    assert dense and nodes.count() < 2 * near.trees * len(rows)
    got = {r.doc_id: r.component_id for r in near.run(docs).collect()}
    assert got == {i: 0 if i < 1000 else i - i % 2 for i, _ in rows}


def test_too_many_trees_are_refused():
    with pytest.raises(ValueError):
        NearCopies(3, 50, 100)


@pytest.mark.parametrize("leaf,levels", [(2000, 8), (3, 2)])
def test_near_copies_against_brute_force(spark, leaf, levels):
    base = [f"a{i}" for i in range(80)]
    rows = [(k, " ".join(base[: k % 7] + [f"z{k}"] * (k % 4) + base[k % 7 :])) for k in range(60)]
    got = NearCopies(3, 85, 100, leaf=leaf, levels=levels).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(rows, 3, 85, 100)
