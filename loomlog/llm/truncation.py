"""Texts cut off by field limits: an unknown final word that known words continue, with length and structure evidence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.tables import cut, join_split
from .mail import parse

#: What senders and stores put after text they cut: fixed forms.
MARKS = re.compile(
    r"(?:\s*(?:\[\W*(?:(?:message|text|mail|body|content|rest)\s+)?(?:truncated|clipped|cut|shortened|trimmed)(?:\s+off)?\W*\]"
    r"|\(\W*(?:more|truncated|clipped|continued|cut)\W*\)|<\.\.\.>|<(?:truncated|clipped|more)>|…|\.\.\.|�+|\x00+))\s*$",
    re.I,
)
QUOTE = re.compile(r"(?m)^[ \t]*[>|](?:[ \t]?[>|])*[ \t]?")
PIECE = re.compile(r"[^\W\d_]+|\d+|[.!?]+|\n[ \t]*\n")
COUNTED = re.compile(r"[^\W\d_]+|#|[.!?]")
DIGITS = re.compile(r"\d+")
GAP = re.compile(r"\n[ \t]*\n")
STOPS = frozenset(".!?")
SCAN = (
    "kind int, doc_id bigint, source string, chars bigint, bytes bigint, marked boolean, open string, body boolean, plain boolean, "
    "tail string, before string, ended boolean, length int, spaced boolean, word string, n bigint, n_end bigint"
)
FLUSH_WORDS = 200_000
RARE = 1000
MARK_ENDS = frozenset("])>….\ufffd\x00")
MARK_WORDS = 3  # no mark has more words
RUN = re.compile(r"\w+")
STRAYS = "\ufffd" + "".join(map(chr, range(9)))
DEEP = 40  # from this length on, prefixes are made only where a text ends in one


def unmarked(text: str) -> str:
    """The text without the cut marks at its end.

    Looks at as much of the end as can be a mark: until it holds more words
    than any mark, or is the whole text.
    """
    while True:
        body = text.rstrip()
        if body[-1:] not in MARK_ENDS or not body:
            return text
        n = 120
        while n < len(body) and len(RUN.findall(body[-n:])) <= MARK_WORDS + 1:
            n *= 4
        bare = MARKS.sub("", body[-n:])
        if len(bare) == min(n, len(body)):
            return text
        text = body[: max(0, len(body) - n)] + bare


def _unstrayed(text: str) -> str:
    """The text without white space, control characters and lines of at most four stray marks at its end."""
    while True:
        text = text.rstrip().rstrip(STRAYS)
        line = text[text.rfind("\n") + 1 :] if "\n" in text[-5:] else None
        if line is None or RUN.search(line):
            short = text.rstrip()
            if len(short) == len(text):
                return text
            text = short
        else:
            text = text[: len(text) - len(line) - 1]


def tail_of(text: str) -> tuple[str, str, bool, int, bool]:
    """How a text ends: (final word, the one before, is it at a sentence's end, words of its last sentence, does white space follow).

    Whole lines are taken from the end, more and more of them until they hold
    the beginning of the last sentence.
    """
    core = unmarked(text)
    spaced = core.endswith(" ")
    core = _unstrayed(core)
    n = 1000
    while True:
        at = core.rfind("\n", 0, max(0, len(core) - n)) + 1
        part = QUOTE.sub("", core[at:]).rstrip()
        for some in (part[-400:], part):  # most sentences are short
            words_back: list[str] = []
            found = False
            for t in reversed(PIECE.findall(some)):
                if t[0] in ".!?\n":
                    found = True
                    break
                words_back.append(t)
            if found:
                break
        if found or at == 0:
            break
        n *= 4
    last = part[-1:]
    ended = not (last.isalnum() or last == "_" or last in ",-'’/+=&(<\"“")
    w = [("#" if t.isdigit() else t.lower()) for t in words_back[:2]]
    return (w[0] if w else "", w[1] if len(w) > 1 else "", ended, len(words_back), spaced)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One pass over whole texts: a row per document (kind 0) and local word counts (kind 1), as a written table.

    A word row says how often a word stood, and how often at the end of a
    sentence or paragraph; a text's final word is not counted. Counts leave a
    task whenever 200,000 words are held, so memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        names = [f.split()[0] for f in SCAN.split(", ")]
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        types = [kinds[f.split()[1]] for f in SCAN.split(", ")]

        def table(cols: dict[str, list], n: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array(cols.get(c, [None] * n), t) for c, t in zip(names, types, strict=True)], names=names)

        def flush() -> pa.RecordBatch:
            w = [x for x in total if x not in STOPS]
            out = table({"kind": [1] * len(w), "word": w, "n": [total[x] for x in w], "n_end": [ends[x] for x in w]}, len(w))
            total.clear()
            ends.clear()
            return out

        for b in batches:
            rows: dict[str, list] = {c: [] for c in names[:14]}
            for d, t, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                t = t.as_py() or ""
                m = parse(t)
                bare = unmarked(t)
                end = ("", "", True, 0, False)
                if m.plain_end and m.parts:
                    end = tail_of(m.parts[-1][1])
                values = [0, d, s, len(bare), len(bare.encode("utf-8", "replace")), bare != t.rstrip() and len(bare) < len(t.rstrip()), m.open, m.body, m.plain_end, *end]
                for c, v in zip(rows, values, strict=True):
                    rows[c].append(v)
                for k, (_, part) in enumerate(m.parts):
                    plain = DIGITS.sub("#", GAP.sub(" . ", QUOTE.sub("", part).lower()))
                    toks = COUNTED.findall(plain)
                    if k == len(m.parts) - 1:
                        while toks and toks[-1] in STOPS:
                            toks.pop()
                        toks = toks[:-1]
                    toks.append(".")
                    total.update(toks)
                    ends.update([w for w, nxt in zip(toks, toks[1:], strict=False) if nxt in STOPS])
                if len(total) >= FLUSH_WORDS:
                    yield flush()
            yield table(rows, len(rows["kind"]))
        if total:
            yield flush()

    return cut(docs.select(F.col(doc_id).cast("bigint"), F.col(text), F.col(source)).mapInArrow(run, SCAN))


def vocabulary(scanned: DataFrame) -> DataFrame:
    """(word, n, n_end) over all documents."""
    return scanned.filter("kind = 1").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def trie(vocab: DataFrame, least: int = 3, ends: DataFrame | None = None) -> DataFrame:
    """The vocabulary's trie as a table of its inner nodes: (prefix, below, words).

    A node is a proper prefix of words seen at least ``least`` times;
    ``below`` sums their occurrences, ``words`` counts them. Nodes are
    partitioned by prefix like any key, so the trie may be of any size. With
    ``ends`` (column w), nodes of more than 40 letters are made only where one
    of these texts' ends begins alike and has that length, so that a very long
    word doesn't make as many nodes as it has letters, each as long; without
    it all are made.
    """
    known = vocab.filter((F.col("n") >= least) & (F.length("word") > 1))
    most = F.length("word") - 1 if ends is None else F.least(F.length("word") - 1, F.lit(DEEP))
    node = known.select("n", F.explode(F.transform(F.sequence(F.lit(1), most), lambda i: F.left(F.col("word"), i))).alias("prefix"))
    if ends is not None:
        head = lambda c: F.left(F.col(c), F.lit(DEEP)).alias("head")
        deep = ends.filter(F.length("w") > DEEP).select(head("w"), F.length("w").alias("l")).distinct()
        long = known.filter(F.length("word") > DEEP).select("n", "word", head("word")).join(deep, "head").filter(F.col("l") < F.length("word"))
        node = node.unionByName(long.select("n", F.left(F.col("word"), F.col("l")).alias("prefix")))
    return node.groupBy("prefix").agg(F.sum("n").alias("below"), F.count(F.lit(1)).alias("words"))


def limits(scanned: DataFrame, least: int = 5, times: int = 8) -> DataFrame:
    """Length evidence: (source, unit, size) at which a source's texts pile up.

    ``unit`` is "chars" or "bytes". A size is a limit if at least ``least``
    texts have it, one in 200 of the source's, and ``times`` as many as the
    mean size within 100 of it. Sizes are counted map-side; a window runs over
    a source's distinct sizes, not over its texts.
    """
    d = scanned.filter("kind = 0")
    sizes = d.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x"))
    per = sizes.select("source", "x.unit", "x.size").filter("size > 0").groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("c"))
    near = F.sum("c").over(W.partitionBy("source", "unit").orderBy("size").rangeBetween(-100, 100))
    every = F.sum("c").over(W.partitionBy("source", "unit"))
    marked = per.withColumn("near", near - F.col("c")).withColumn("every", every)
    return marked.filter((F.col("c") >= least) & (F.col("c") * 200 >= F.col("every")) & (F.col("c") * 200 >= F.col("near") * times)).select("source", "unit", "size")


def evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", scanned: DataFrame | None = None) -> DataFrame:
    """Per document what speaks for a cut: doc_id, source, prefix, at_limit, and the parts of the plain rule.

    ``prefix``: the final word is unknown (seen elsewhere fewer than 3 times,
    or a thousand times less than the words it begins) and a proper prefix of
    known words. ``at_limit``: the text, without a cut
    mark, has a length at which its source's texts pile up. Null and empty
    texts and texts of headers only have no evidence; a null source is a
    source of its own. Repeated ids give a row each.
    """
    s = scan(docs, doc_id, text, source) if scanned is None else scanned
    d = s.filter("kind = 0").drop("kind", "word", "n", "n_end")
    vocab = cut(vocabulary(s))
    finals = d.filter("plain and tail != ''").groupBy(F.col("tail").alias("w")).agg(F.count(F.lit(1)).alias("docs"))
    known = vocab.filter("n >= 3").select(F.col("word").alias("w"), "n", "n_end")
    node = trie(vocab, ends=finals).select(F.col("prefix").alias("w"), "below")
    facts = finals.join(known, "w", "left").join(node, "w", "left").withColumnRenamed("w", "tail")
    # Texts without a final word stay out of the join; frequent final words meet their facts by a bounded broadcast.
    ends = F.col("plain") & (F.col("tail") != "")
    facts = cut(facts)
    named = join_split(d.filter(ends), facts.drop("docs"), ["tail"], facts.select("tail", F.col("docs").alias("n")))
    bare = d.filter(~F.coalesce(ends, F.lit(False)))
    lim = limits(s)
    as_limit = lambda unit: lim.filter(F.col("unit") == unit).select(F.col("source").alias("__s"), F.col("size").alias(f"__{unit}"))
    j = named.unionByName(bare, allowMissingColumns=True)
    for unit in ("chars", "bytes"):
        r = as_limit(unit).groupBy("__s").agg(F.collect_set(f"__{unit}").alias(f"__{unit}"))  # a source has few limits
        j = j.join(r, j["source"].eqNullSafe(r["__s"]), "left").drop("__s")
    near = F.exists(F.coalesce("__bytes", F.array().cast("array<bigint>")), lambda x: (F.col("bytes") <= x) & (F.col("bytes") > x - 4) & (F.col("bytes") > F.col("chars")))
    hit = F.coalesce(F.array_contains("__chars", F.col("chars")), F.lit(False)) | F.coalesce(F.array_contains("__bytes", F.col("bytes")), F.lit(False)) | near
    # A word that is rare against the words it begins is no word but other texts' remains.
    unknown = F.col("n").isNull() | (F.col("n") * RARE < F.col("below"))
    in_words = F.col("plain") & ~F.col("ended") & (F.col("tail") != "") & (F.col("tail") != "#")
    return j.select(
        "doc_id",
        "source",
        "body",
        (in_words & unknown & F.col("below").isNotNull()).alias("prefix"),
        (F.col("body") & hit).alias("at_limit"),
        "open",
        "marked",
        "plain",
        "ended",
        "tail",
        "before",
        "length",
        "spaced",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_end", F.lit(0)).alias("n_end"),
    )


def by_method(seen: DataFrame) -> DataFrame:
    """The named method alone: an unknown final prefix, or a plain text that stops unended at its source's limit."""
    return seen.filter(F.col("body") & (F.col("prefix") | (F.col("at_limit") & ~F.col("ended"))))


def truncated(seen: DataFrame, rare_end: float = 0.02) -> DataFrame:
    """The plain rule: texts that stop inside a word, a sentence, or an encoded or marked-up block.

    A block is open if its boundary, closing tag or last code group is missing.
    A sentence is open if the text doesn't end in punctuation and its last
    word is an unknown prefix or almost never ends a sentence or paragraph
    elsewhere; for any other word a cut mark, white space behind it, or its
    source's limit is enough. A complete message that happens to have the
    limit's length ends in punctuation or a closed block, and is no case.
    """
    unended = F.col("plain") & ~F.col("ended") & (F.col("tail") != "")
    seldom = (F.col("n") > 0) & (F.col("n_end") <= F.col("n") * rare_end)
    rule = (F.col("open") != "") | F.col("prefix") | (unended & (F.col("at_limit") | seldom | F.col("marked") | F.col("spaced")))
    return seen.filter(F.col("body") & rule)


def shares(seen: DataFrame, found: DataFrame) -> DataFrame:
    """(source, docs, truncated, share): how often each source cuts texts."""
    hit = found.select("doc_id").distinct().withColumn("__t", F.lit(1))
    j = seen.select("doc_id", "source").join(hit, "doc_id", "left")
    out = j.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("__t").alias("truncated"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("docs"), 4))
