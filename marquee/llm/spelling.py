"""Spelling variants: words one edit apart, found by moving a frontier of states through a trie that is a table of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import discard, lower_ascii, stored, table
from marquee.operators.duplicates import resolve_keepers

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points and occurrences of a word at least, and how many times as frequent the form of a word is.
LEAST, OFTEN, TIMES = 7, 2, 10
#: Letters left that edges tell apart; the last stands for all above it.
_MANY = 63
#: Length of words whose depths fit into the bits of one number; longer ones have them listed.
_MASK = 62
#: One run in so many loses a letter.
SLIP = 31


def slipped_words(docs: DataFrame, least: int = LEAST, often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts: maximal runs of letters with A-Z lower-cased, one in ``SLIP`` of which, chosen by document and run,
    lacks a code point. Runs shorter than ``least`` can't become words, and a run is matched whole or not at all."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found.alias("run")).withColumn("run", lower_ascii(F.col("run")))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % SLIP == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= least) & (F.col("n") >= often))


def _node(depth: Column) -> Column:
    """The node that the first letters of a word lead to; each side has its own trie. Equal hashes of two prefixes would only add
    paths, whose ends are compared with words in the end."""
    return F.xxhash64("back", F.substring("word", F.lit(1), depth))


def _key(node: Column, after: int, letter: Column) -> Column:
    """What edges are found by: their node and their first letter, or (``after`` 1) the letter that follows the first."""
    return F.xxhash64(node, F.lit(after), letter)


def trie(words: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Own paths (back, word, cuts) and edges of the path-compressed tries of the words (read from the front, and back to front), below depth
    ``top``. Nodes are the prefixes of length ``top``, those where words part or end, and whole words.

    Edges (key, letter, tail, child, left, shared, nexts) stand under their first letter (``letter`` empty, ``tail`` the label) and, for
    states that put any letter in place of theirs, under what follows it (``letter`` the first, ``tail`` the rest; an empty one under each
    letter of ``nexts``, and under none if a word ends there). ``left`` has a bit for every number of letters that words through
    the child have left there (bit 63: 63 or more), ``shared`` tells whether it is on the way of two words, ``nexts`` are the letters that
    the child's own edges begin with."""
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), "word"), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))).alias("w")).select("w.*")
    at = both.select("back", "word", F.explode(F.sequence(F.lit(top + 1), F.length("word"))).alias("depth")).select("back", "word", "depth", _node(F.col("depth")).alias("node"))
    after = F.ascii(F.substring("word", F.col("depth") + 1, F.lit(1)))  # a code point, 0 at the end: numbers are hashed, texts would be sorted
    parts = stored(at.groupBy("node").agg(F.min(after).alias("a"), F.max(after).alias("z")).filter("a <> z").select("node"))
    inner = at.filter(F.col("depth") < F.length("word")).join(parts.hint("shuffle_hash"), "node", "left_semi").select("back", "word", "depth")
    ends = both.select("back", "word", F.explode(F.array(F.lit(top), F.length("word"))).alias("depth"))
    depths, short = inner.unionByName(ends), F.length("word") <= _MASK
    masks = depths.filter(short).groupBy("back", "word").agg(F.expr("bit_or(shiftleft(1L, depth))").alias("mask"))
    listed = masks.select("back", "word", F.filter(F.sequence(F.lit(top), F.length("word")), lambda d: F.bit_get("mask", d) == 1).alias("cuts"))
    long = depths.filter(~short).groupBy("back", "word").agg(F.array_sort(F.collect_set("depth")).alias("cuts"))
    paths = stored(listed.unionByName(long))
    discard(parts)
    steps = paths.select("back", "word", F.explode(F.arrays_zip(F.slice("cuts", 1, F.size("cuts") - 1).alias("f"), F.slice("cuts", 2, F.size("cuts")).alias("t"))).alias("s")).select("back", "word", "s.*")
    left = F.expr(f"shiftleft(1L, least(length(word) - t, {_MANY}))")
    edges = steps.select(_node(F.col("f")).alias("node"), F.substring("word", F.col("f") + 1, F.col("t") - F.col("f")).alias("label"), _node(F.col("t")).alias("child"), left.alias("left"))
    plain = stored(edges.groupBy("node", "label", "child").agg(F.bit_or("left").alias("left"), (F.count("*") > 1).alias("shared")))
    nexts = plain.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("nexts"))
    edges = plain.join(nexts.hint("shuffle_hash"), "child", "left").withColumn("nexts", F.coalesce("nexts", F.lit("")))
    first, rest = F.substring("label", 1, 1), F.substr("label", F.lit(2))
    end = F.when(F.bit_get("left", F.lit(0)) == 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    follow = F.when(rest != "", F.array(F.substring(rest, 1, 1))).otherwise(F.concat(end, F.filter(F.split("nexts", ""), lambda c: c != "")))
    ways = F.concat(F.array(F.struct(_key(F.col("node"), 0, first).alias("key"), F.lit("").alias("letter"), F.col("label").alias("tail"))), F.transform(follow, lambda c: F.struct(_key(F.col("node"), 1, c).alias("key"), first.alias("letter"), rest.alias("tail"))))
    keyed = stored(edges.select(F.explode(ways).alias("w"), "child", "left", "shared", "nexts").select("w.*", "child", "left", "shared", "nexts"))
    discard(plain)
    return paths, keyed


def one_edit_links(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, near), both ways, of distinct words that differ by one inserted, deleted or replaced code point.

    A state is a word, how far it is read, a node and the edit so far (``near``, what the word becomes; null before it). States
    go down one level at a time by a join with the edge table. A word without an edit keeps to its own path and
    may leave it at any node by replacing or deleting its next letter; the rest of the word then has to be the path
    on. Insertions are deletions seen from the longer word. So each state asks for the edges of a node by a letter that it
    knows: its next one, or the one after that if the next is deleted or any other letter is put in its place. An edit leaves the
    first or the last half of a word as it is, so there are no edits before the half in the trie of words and in that of words back to
    front: where tries are dense, states have one way to go. A word stops where it shares its path with no other, an edited one where
    no word below has as many letters left and the next letter.
    """
    top = least // 2
    paths, edges = trie(words.select("word"), top)
    half = F.floor((F.length("word") + F.col("back").cast("int")) / 2).cast("int")  # both halves make up the word
    begin = F.array_max(F.filter("cuts", lambda c: c <= half))
    states = paths.select("back", "word", begin.alias("at"), F.lit(None).cast("string").alias("near")).withColumn("node", _node(F.col("at")))
    found, tables = [], []
    while True:
        next_, second = F.substring("word", F.col("at") + 1, F.lit(1)), F.substring("word", F.col("at") + 2, F.lit(1))
        ask = lambda skip, after, letter: F.struct(F.lit(skip).alias("skip"), _key(F.col("node"), after, letter).alias("key"))
        on, deleted, replaced = ask(0, 0, next_), ask(1, 0, second), ask(1, 1, second)
        edits = F.col("near").isNull() & (F.col("at") >= half)
        asked = F.when(~edits, F.array(on)).when((second == "") | (second == next_), F.array(on, replaced)).otherwise(F.array(on, deleted, replaced))
        asking = states.select("back", "word", "at", "near", F.explode(asked).alias("q")).select("back", "word", "at", "near", "q.*")
        met = asking.join(edges.hint("shuffle_hash"), "key")
        fits = F.substr("word", F.col("at") + F.col("skip") + 1).startswith(F.col("tail")) & ((F.col("letter") == "") | (F.col("letter") != next_))
        to = (F.col("at") + F.col("skip") + F.length("tail")).alias("to")
        near = F.when(F.col("skip") == 0, F.col("near")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("at")), "letter", F.substr("word", F.col("at") + 2))).alias("near")
        is_word = (F.bit_get("left", F.lit(0)) == 1).alias("is_word")
        there = met.filter(fits).select("back", "word", to, near, F.col("child").alias("node"), is_word, "left", "shared", "nexts")
        # A word on its own path meets no other where none shares it; an edit goes on where a word has as many letters left, and the next one.
        remain = F.bit_get("left", F.least(F.length("word") - F.col("to"), F.lit(_MANY))) == 1
        ahead = (F.col("to") == F.length("word")) | F.contains("nexts", F.substring("word", F.col("to") + 1, F.lit(1)))
        goes = F.when(F.col("near").isNull(), F.col("shared")).otherwise(remain & ahead)
        states = stored(there.filter(goes).select("back", "word", F.col("to").alias("at"), "near", "node", "is_word"))
        tables.append(states)
        last = F.when(F.col("near").isNotNull() & (F.col("at") == F.length("word")), F.col("near")).when(F.col("near").isNull() & (F.col("at") == F.length("word") - 1), F.substring("word", F.lit(1), F.col("at")))
        found.append(states.filter("is_word").select("back", "word", last.alias("near")).filter("near IS NOT NULL"))
        states = states.filter(F.col("at") < F.length("word")).drop("is_word")
        if states.isEmpty():
            break
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    met = reduce(DataFrame.unionByName, found).select(turned("word"), turned("near"))
    links = stored(met.unionByName(met.filter(F.length("near") < F.length("word")).select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct())
    discard(*tables, paths, edges)
    return links


def spelling_forms(words: DataFrame, links: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is the most frequent of its near words (of equally frequent ones the first in
    code-point order) if that is ``times`` as frequent; its root is what following forms ends at."""
    near = links.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    rows = words.join(best, "word", "left")
    taken = F.col("near_n") >= times * F.col("n")
    rows = stored(rows.select("word", F.when(taken, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("near_n")).alias("form_n")))
    roots = resolve_keepers(rows.filter("form IS NOT NULL").select(F.col("word").alias("media_key"), F.col("form").alias("parent"))).select(F.col("media_key").alias("word"), F.col("keeper").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_forms`` over the words of ``slipped_words``.

    Null and empty texts have no words, a null doc_id stands for an empty one, repeated rows count as often as they stand there,
    an empty table gives no rows, and words of any length are words.
    """
    words = stored(slipped_words(docs, id_col=id_col, text_col=text_col))
    return spelling_forms(words, one_edit_links(words))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling": op12_spelling}
ORACLE_SQL: dict[str, str] = {}
