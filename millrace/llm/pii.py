"""Personal data: fixed patterns, and bootstrapped contextual extraction of further identifiers.

The spans of the fixed patterns, and tokens in the form of well-known keys, are seed
entities. Around an entity stand lexical patterns of three kinds: the two words before
it, the words before and after it, and the word before it with the signs that its own
word begins with; a fourth is the shape of the token itself. Patterns and instances
form a graph that is scored in rounds until no belief moves: a pattern's confidence is
the believed part of its occurrences in the corpus, whatever word stands there, but
for identifier-like tokens that are not believed yet, which speak neither for nor
against it (a shape's: of all tokens of that shape); an identifier-like token is
believed as far as the confident patterns of its occurrences say, and believed tokens
are seeds of the next round. Beliefs only grow, so the rounds end. Everything is
DataFrame functions; the rounds run on the small table of entities and tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, heavy_keys, small, split_join, stored, text_or_empty

#: Kinds of spans: the fixed patterns', keys in a known form, and what the method finds.
KINDS = ("email", "ip", "card", "phone", "key", "id")
#: Fixed patterns, written so that no text takes more than linear time; the matches are
#: those of the plain forms, leftmost and without overlap.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that may be an identifier: six signs or more, two digits at least.
TOKEN = r"(?<![A-Za-z0-9._@+/-])(?=[A-Za-z._@+/-]*+[0-9][A-Za-z._@+/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._@+/-]{4,}[A-Za-z0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Forms of keys: digests of 32, 40 and 64 hexadecimal digits with letters and digits, and prefixes of access keys.
KEY = r"^(?:(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,})$"
#: The signs that a word begins with.
LEAD = r"^[^\p{L}\p{N}]+"
#: Rounds end when the beliefs' sum grows by no more than this.
SETTLED = 1e-6
#: A pattern needs so many different believed instances, and this confidence; an instance this belief.
LEAST_INSTANCES, LEAST_CONFIDENCE, LEAST_BELIEF = 3, 0.8, 0.8
#: Parts in which patterns are counted: bounds of a hash of doc_id; together they are all documents.
PARTS = (0, 1, 8, 64)
_SPAN = "array<struct<start:int,end:int,value:string,word:int>>"


def located(text: Column, pattern: str) -> Column:
    """All matches with start and end in code points, their text, and the place among the text's words of the word they begin in."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit(False).alias("open"), F.array().cast(_SPAN).alias("out"))
    in_word = lambda sign: F.regexp_like(sign, F.lit(WORD))

    def passed(words: Column, open_: Column, piece: Column) -> tuple[Column, Column]:
        """Words begun up to the end of the piece, and whether the last one may go on behind it."""
        begun = words + F.regexp_count(piece, F.lit(WORD)) - (open_ & in_word(F.left(piece, F.lit(1)))).cast("int")
        return begun, F.when(piece == "", open_).otherwise(in_word(F.right(piece, F.lit(1))))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.char_length(x["gap"])
        end = first + F.char_length(x["hit"])
        words, open_ = passed(acc["words"], acc["open"], x["gap"])
        after, still = passed(words, open_, x["hit"])
        span = F.struct(first.alias("start"), end.alias("end"), x["hit"].alias("value"), (words - open_.cast("int")).alias("word"))
        new = F.struct(end.alias("at"), after.alias("words"), still.alias("open"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(x["hit"].isNull(), acc).otherwise(new)

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _only_if(condition: Column, spans: Column) -> Column:
    return F.coalesce(F.when(condition, spans), F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """The valid matches of each fixed pattern; texts without its key character are not scanned."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.regexp_like(s["value"], F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": lambda s: F.call_function("luhn_check", digits(s)),
        "phone": lambda s: F.length(digits(s)).between(10, 15),
    }
    has_digit = F.regexp_like(text, F.lit("[0-9]"))
    needs = {"email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": F.contains(text, F.lit("+"))}
    return {k: F.filter(_only_if(needs[k], located(text, p)), valid[k]) for k, p in PATTERNS.items()}


def _contexts(words: Column, first: Column, last: Column) -> Column:
    """Hashes of the lexical patterns around words first to last of the text: what stands beyond it makes no pattern."""
    before = F.get(words, first - 1)
    lead = F.regexp_extract(F.get(words, first), LEAD, 0)
    two = F.when(first >= 2, F.xxhash64(F.lit("two"), F.get(words, first - 2), before))
    around = F.when((first >= 1) & (last + 1 < F.size(words)), F.xxhash64(F.lit("around"), before, F.get(words, last + 1)))
    signs = F.when((first >= 1) & (lead != ""), F.xxhash64(F.lit("signs"), before, lead))
    return F.filter(F.array(two, around, signs), lambda p: p.isNotNull())


def _shape(value: Column) -> Column:
    """Hash of a token's shape: its runs of letters and of digits with their lengths, hexadecimal digits as one run."""
    hexa = F.regexp_like(value, F.lit(r"^(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{16,}$"))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    return F.xxhash64(F.lit("shape"), F.when(hexa, F.concat(F.lit("hex"), F.length(value))).otherwise(runs))


def entities(docs: DataFrame) -> DataFrame:
    """rid, doc_id and `items`: seeds and other identifier-like tokens with their word's place and the patterns around them."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), text.alias("text"))
    rows = rows.withColumns(base_spans(F.col("text")))
    tokens = _only_if(F.regexp_like("text", F.lit("[0-9][^0-9]*[0-9]")), located(F.col("text"), TOKEN))
    rows = rows.withColumn("id", tokens)
    some = F.greatest(*[F.size(k) for k in (*PATTERNS, "id")]) > 0
    rows = rows.withColumn("words", F.when(some, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))

    def tagged(spans: str, kind) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                kind(s).alias("kind"),
                s["end"].alias("end"),
                s["value"].alias("value"),
                s["word"].alias("word"),
                _contexts(F.col("words"), s["word"], s["word"] + F.regexp_count(s["value"], F.lit(WORD)) - 1).alias("patterns"),
            ),
        )

    base = F.concat(*[tagged(k, lambda s, k=k: F.lit(KINDS.index(k))) for k in PATTERNS])
    rows = rows.withColumn("base", base)
    own = lambda s: F.when(F.regexp_like(s["value"], F.lit(KEY)), KINDS.index("key")).otherwise(KINDS.index("id"))
    free = F.filter(tagged("id", own), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return rows.select("doc_id", "rid", F.concat("base", free).alias("items"))


def pattern_totals(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, total): at how many words each pattern of wanted(pattern, n) stands, in all texts.

    All texts are counted, in growing parts. A pattern that already stands at more
    words than its n entities could ever make confident is settled, and is not counted
    on; so common words cost no more than rare ones. Those that stay have their full
    totals.
    """
    words = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS[-1])).alias("part"), text_or_empty().alias("text"))
    left = wanted.withColumn("total", F.lit(0).cast("long"))
    near = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("a"), F.col("w").alias("b"), F.expr("slice(w, 2, size(w))").alias("c"))
    inside = F.col("a").isNotNull() & F.col("c").isNotNull()
    two = F.when(inside, F.xxhash64(F.lit("two"), F.col("a"), F.col("b")))
    around = F.when(inside, F.xxhash64(F.lit("around"), F.col("a"), F.col("c")))
    lead = F.regexp_extract("b", LEAD, 0)
    signs = F.when(F.col("a").isNotNull() & (lead != ""), F.xxhash64(F.lit("signs"), F.col("a"), lead))
    for low, high in zip(PARTS, PARTS[1:]):
        n_left = left.count()
        some = words.filter((F.col("part") >= low) & (F.col("part") < high)).select(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
        seen = some.filter(F.size("w") >= 2).select(F.inline(near).alias("a", "b", "c")).filter("b is not null")
        seen = seen.select(F.explode(F.array(two, around, signs)).alias("pattern"))
        seen = seen.join(small(left.select("pattern"), n_left, 1_000_000), "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("more"))
        left = left.join(seen, "pattern", "left").select("pattern", "n", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        left = stored(left.filter(F.col("total") * F.lit(LEAST_CONFIDENCE) <= F.col("n") + F.lit(1e-6)))
    return left.select("pattern", "total")


def discover(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, belief): the tokens that confident patterns reveal, among items(rid, word, value, kind, patterns). Entities that begin in one word share its occurrence."""
    own = KINDS.index("id")
    share = 1 / F.count(F.lit(1)).over(W.partitionBy("rid", "word"))
    pairs = ["pattern", "value"]
    around = items.withColumn("share", share).select("value", "kind", "share", F.explode("patterns").alias("pattern"))
    around = around.groupBy(*pairs).agg(F.sum("share").alias("n"), F.min("kind").alias("kind"))
    tokens = items.filter(F.col("kind") >= KINDS.index("key")).select("value", "kind", _shape(F.col("value")).alias("pattern"))
    shaped = tokens.groupBy(*pairs).agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("kind").alias("kind"))
    around, shaped = stored(around), stored(shaped)

    def enough(graph: DataFrame) -> DataFrame:
        return graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).filter(F.col("values") >= LEAST_INSTANCES)

    wanted = stored(enough(around).select("pattern", "n"))
    # Occurrences without an entity; a shape has none, and all its tokens speak.
    plain = pattern_totals(docs, wanted).join(wanted, "pattern").select("pattern", (F.col("total") - F.col("n")).alias("plain"))
    totals = stored(plain.unionByName(enough(shaped).select("pattern", F.lit(None).cast("double").alias("plain"))))
    edges = stored(around.unionByName(shaped).join(totals, "pattern"))
    # A value may stand in many patterns (a common number), and a pattern hold many values.
    counts = stored(edges.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    heavy = heavy_keys(counts, ["value"], edges.count())
    belief = stored(edges.select("value", F.lit(0.0).alias("belief")).limit(0))
    settled = 0.0
    while True:
        believed = F.when(F.col("kind") < own, F.lit(1.0)).otherwise(F.coalesce("belief", F.lit(0.0)))
        scored = split_join(edges, belief, ["value"], heavy, "left").withColumn("believed", believed)
        for_it = F.sum(F.col("believed") * F.col("n"))
        pattern = scored.groupBy("pattern").agg(
            F.try_divide(for_it, F.coalesce(F.first("plain") + for_it, F.sum("n"))).alias("confidence"),
            F.sum((F.col("believed") >= LEAST_BELIEF).cast("int")).alias("instances"),
        )
        good = pattern.filter((F.col("confidence") >= LEAST_CONFIDENCE - 1e-9) & (F.col("instances") >= LEAST_INSTANCES))
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        fresh = edges.filter(F.col("kind") == own).join(good, "pattern").groupBy("value").agg((1 - F.exp(doubt)).alias("belief"))
        belief = stored(fresh.filter(F.col("belief") >= LEAST_BELIEF))
        total = belief.agg(F.coalesce(F.sum("belief"), F.lit(0.0))).first()[0]
        if total <= settled + SETTLED:
            return belief
        settled = total


def find_pii(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, counts of the kinds and of all spans, base_sha256, spans, and `found` with kind, start and end.

    A null text counts as empty; a text of any length is searched whole, in time linear
    in it. Rows that repeat a doc_id are searched one by one. Base spans always stay;
    `key` spans are tokens in the form of a key, `id` spans what the method finds:
    neither overlaps a base span. Spans that start together stand in the order of kinds.
    An empty table gives no rows; columns besides doc_id and text are not read.
    """
    rows = stored(entities(docs))
    own = KINDS.index("id")
    each = rows.select("rid", F.explode("items").alias("i")).select("rid", "i.*")
    values = discover(each, docs).select("value")
    tokens = each.filter(F.col("kind") == own).select("rid", "start", "kind", "end", "value")
    counts = stored(tokens.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    n_tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    added = split_join(tokens, values, ["value"], heavy_keys(counts, ["value"], n_tokens))
    added = added.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    plain = F.transform(
        F.filter("items", lambda i: i["kind"] < own), lambda i: F.struct(i["start"].alias("start"), i["kind"].alias("kind"), i["end"].alias("end"))
    )
    whole = rows.select("doc_id", "rid", plain.alias("base")).join(added, "rid", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    whole = whole.withColumns({"base": F.array_sort("base"), "found": every})
    fixed = F.filter("base", lambda s: s["kind"] < len(PATTERNS))
    kinds = F.transform("found", lambda s: s["kind"])
    n_of = [F.size(F.filter(kinds, lambda k: k == F.lit(KINDS.index(name)))).cast("long").alias(f"n_{name}") for name in KINDS]
    n_of.append(F.size("found").cast("long").alias("n_spans"))
    named = F.transform("found", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return whole.select("doc_id", *n_of, F.sha2(text_of(fixed), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"), named.alias("found"))
