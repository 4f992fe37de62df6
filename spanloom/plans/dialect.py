"""One relational text for an operator, for Spark and for ANSI engines with the same tables.

A text names its relations in braces and uses a few macros where engines spell a thing differently.
On Spark the relations are DataFrames, so Catalyst plans the whole text at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SPARK = {
    "I": r"CAST(\1 AS BIGINT)",
    "SECS": r"(unix_micros(to_timestamp(\1)) / 1e6 - 1704067200e0)",
    "DAY": r"date_format(\1, 'yyyyMMdd')",
    "RX": r"regexp_like(\1)",
    "STRIP": r"regexp_replace(\1)",
    "PCT": r"percentile(\1)",
    "TEXTAGG": r"array_join(transform(array_sort(collect_list(struct(\2 AS k, \1 AS v))), x -> x.v), \3)",
    "HASHINT": r"CAST(conv(substr(sha1(\1), 1, 8), 16, 10) AS BIGINT)",
    "DIV": r"try_divide(\1)",
    "STR": r"CAST(\1 AS STRING)",
    "JSONINT": r"CAST(get_json_object(\1, '$.\2') AS BIGINT)",
    "ARGMAX": r"max_by(\1, \2)",
    "LOG2": r"log2(\1)",
    "BYTES": r"octet_length(\1)",
    "ARR": r"array(\1)",
    "RX1": r"regexp_extract(\1, 1)",
    "STDPOP": r"stddev_pop(\1)",
    "TRYD": r"try_cast(\1 AS DOUBLE)",
    "BOOLAND": r"bool_and(\1)",
    # Numbers of the stretches of a time line that lie between two places, a row for each.
    "BINS": r"explode(sequence(CAST(floor((\1) / 36e2) AS BIGINT), CAST(floor((\2) / 36e2) AS BIGINT)))",
    "LASTOF": r"(length(\1) - locate(reverse(\2), reverse(\1)) - length(\2) + 2) * CAST(contains(\1, \2) AS INT)",
    "SHA256": r"sha2(\1, 256)",
    "DAYOF": r"try_cast(\1 AS TIMESTAMP)",
}
_ANSI = _SPARK | {
    "SECS": r"(epoch_us(\1) / 1e6 - 1704067200e0)",
    "DAY": r"strftime(\1, '%Y%m%d')",
    "RX": r"regexp_matches(\1)",
    "STRIP": r"regexp_replace(\1, 'g')",
    "PCT": r"quantile_cont(\1)",
    "TEXTAGG": r"string_agg(\1, \3 ORDER BY \2)",
    "HASHINT": r"CAST(concat('0x', substr(sha1(\1), 1, 8)) AS BIGINT)",
    "DIV": None,
    "STR": r"CAST(\1 AS VARCHAR)",
    "JSONINT": r"CAST(json_extract_string(\1, '$.\2') AS BIGINT)",
    "ARGMAX": r"arg_max(\1, \2)",
    "BYTES": r"strlen(\1)",
    "ARR": r"[\1]",
    "BINS": r"unnest(range(CAST(floor((\1) / 36e2) AS BIGINT), CAST(floor((\2) / 36e2) AS BIGINT) + 1))",
    "SHA256": r"sha256(\1)",
    "LASTOF": r"(length(\1) - instr(reverse(\1), reverse(\2)) - length(\2) + 2) * CAST(contains(\1, \2) AS INT)",
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call whose parenthesis opens before ``at``, and where it ends."""
    depth, out, begin, quoted = 1, [], at, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[begin:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(text)


#: Macros with so many arguments; others take all of them as one.
_MANY = {"TEXTAGG": 3, "JSONINT": 2, "ARGMAX": 2, "BINS": 2, "LASTOF": 2}


def _expand(text: str, rules: dict) -> str:
    while m := re.search(r"\b(R6|" + "|".join(rules) + r")\(", text):
        args, end = _arguments(text, m.end())
        if m[1] == "R6":
            new = f"(floor(({args[0]}) * 1e6 + 5e-1) / 1e6)"
        elif m[1] == "DIV" and rules["DIV"] is None:
            new = f"(({args[0]}) / nullif({args[1]}, 0))"
        else:
            new = rules[m[1]]
            for k, a in enumerate(args if m[1] in _MANY else [", ".join(args)], 1):
                new = new.replace(f"\\{k}", a)
        text = text[: m.start()] + new + text[end:]
    return text


_CLEAN = {
    "spark": "filter(transform(split(regexp_replace(lower(trim(regexp_replace(text, '[ \\\\t\\\\n\\\\r]+', ' '))), '[^a-z0-9 ]', ''), ' '), (x, p) -> named_struct('p', p, 't', x)), y -> y.t <> '')",
    "ansi": "list_filter(list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), lambda x, k: struct_pack(p := k - 1, t := regexp_replace(lower(x), '[^a-z0-9]', '', 'g'))), lambda y: y.t <> '')",
}
_FIVE = ", ".join(f"get(ts, i + {k}).t" for k in range(5))
#: Rows of a text without a shuffle: its words (p, w); its tokens (i, and p, the word's place, t); and its runs of five
#: tokens (i of the first, g, and wp, wl, the places of the first and last word; g is what they are joined by: on Spark 128 bits of a hash); and its runs of six words between all that
#: isn't a letter or digit (g), with twelve or as many as there are (tail).
INPLACE = {
    "words": {
        "spark": "(SELECT {0} AS src, p, w FROM {1} LATERAL VIEW posexplode(filter(split(text, '[ \\\\t\\\\n\\\\r]+'), x -> x <> '')) t AS p, w)",
        "ansi": "(SELECT {0} AS src, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS w FROM (SELECT {0}, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM {1}))",
    },
    "tokens": {
        "spark": f"(SELECT {{0}} AS src, i, y.p AS p, y.t AS t FROM {{1}} LATERAL VIEW posexplode({_CLEAN['spark']}) z AS i, y)",
        "ansi": f"(SELECT src, i, y.p AS p, y.t AS t FROM (SELECT {{0}} AS src, generate_subscripts(ts, 1) - 1 AS i, unnest(ts) AS y FROM (SELECT {{0}}, {_CLEAN['ansi']} AS ts FROM {{1}})))",
    },
    "shingles": {
        "spark": f"(SELECT src, y.* FROM (SELECT {{0}} AS src, ts FROM {{1}} LATERAL VIEW explode(array({_CLEAN['spark']})) q AS ts WHERE size(ts) >= 5) LATERAL VIEW explode(transform(sequence(0, size(ts) - 5), i -> named_struct('i', i, 'g', named_struct('a', xxhash64({_FIVE}), 'b', xxhash64(5, {_FIVE})), 'wp', get(ts, i).p, 'wl', get(ts, i + 4).p))) z AS y)",
        "ansi": f"(SELECT src, i, array_to_string(list_transform(ts[i + 1:i + 5], lambda y: y.t), ' ') AS g, ts[i + 1].p AS wp, ts[i + 5].p AS wl FROM (SELECT src, ts, unnest(range(0, len(ts) - 4)) AS i FROM (SELECT {{0}} AS src, {_CLEAN['ansi']} AS ts FROM {{1}})))",
    },
    "openings": {
        "spark": "(SELECT src, i, array_join(slice(ws, i + 1, 6), ' ') AS g, array_join(slice(ws, i + 1, 12), ' ') AS tail FROM (SELECT {0} AS src, filter(split(lower(text), '[^a-z0-9]+'), x -> x <> '') AS ws FROM {1}) LATERAL VIEW explode(CASE WHEN size(ws) >= 6 THEN sequence(0, size(ws) - 6) ELSE array() END) z AS i)",
        "ansi": "(SELECT src, i, array_to_string(ws[i + 1:i + 6], ' ') AS g, array_to_string(ws[i + 1:i + 12], ' ') AS tail FROM (SELECT src, ws, unnest(range(0, len(ws) - 5)) AS i FROM (SELECT {0} AS src, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM {1})))",
    },
}


def relations(text: str, views: dict[str, str], engine: str) -> str:
    """Puts the texts of named relations in; tables stay in braces for Spark."""
    while m := re.search(r"\{(\w+)\}", text):
        name = m[1]
        of, _, what = name.partition("_")
        if of in ("doc", "item") and what in INPLACE:
            key, table = ("doc_id", "documents") if of == "doc" else ("item_id", "benchmark")
            new = INPLACE[what][engine].replace("{0}", key).replace("{1}", "{" + table + "}")
        elif name in TABLES:
            new = f"\0{name}\1" if engine == "spark" else name
        else:
            new = f"({getattr(views[name], 'spark', views[name]) if engine == 'spark' else views[name]})"
        text = text[: m.start()] + new + text[m.end() :]
    return text


#: Relations of the benchmark's runs are sent to all tasks up to so many bytes of its texts; beyond, Spark chooses.
_HINT, SMALL = "/*+ BROADCAST(k) */", 64 << 20


class Twofold(str):
    """A text with another one that says the same on Spark, of the same tables."""

    spark: str

    def __new__(cls, text: str, spark: str):
        own = super().__new__(cls, text)
        own.spark = spark
        return own


class Relational:
    """An operator in one text, or in a Twofold. views: named relations that it may use."""

    def __init__(self, text: str, views: dict[str, str]):
        self.text, self.views = text, views

    def ansi(self) -> str:
        return _expand(relations(self.text, self.views, "ansi"), _ANSI)

    def __call__(self, spark: SparkSession, sf_dir: str = "", **frames: DataFrame) -> DataFrame:
        """Over the tables in sf_dir, or over frames given by the tables' names."""
        text = _expand(relations(getattr(self.text, "spark", self.text), self.views, "spark"), _SPARK)
        used = sorted(set(re.findall("\0(\\w+)\1", text)))
        own = {t: frames[t] if t in frames else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        if _HINT in text and (own["benchmark"].selectExpr("sum(octet_length(text))").first()[0] or 0) > SMALL:
            text = text.replace(_HINT, "")
        return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}"), **own)
