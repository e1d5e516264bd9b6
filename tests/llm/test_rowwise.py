"""Quality rules, packing, personal data, and the two classifiers."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import blocks, packing, pii, quality_classifier, quality_rules, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(words, k):
    c = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    at = [i for i in range(len(words) - k + 1) if c[tuple(words[i : i + k])] > 1]
    return len({j for i in at for j in range(i, i + k)})


def test_blocks_bound_memory():
    batch = pa.RecordBatch.from_pydict({"text": ["ab" * 10, None, "c" * 30, "d"], "k": [0, 1, 2, 3]})
    got = [(b.column(1).to_pylist(), [len(t) for t in ts]) for b, ts in blocks.blocks([batch], most=25)]
    assert got == [([0, 1], [20, 0]), ([2], [30]), ([3], [1])]


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        doc = np.sort(rng.integers(0, 3, n))
        words = rng.integers(0, 3, n)
        order, lcp = quality_rules.suffix_array(words, doc)
        ends = np.searchsorted(doc, doc, side="right")
        suffix = lambda i: (int(doc[i]), *words[i : ends[i]].tolist())
        want = sorted(range(n), key=suffix)
        assert [suffix(i) for i in order] == [suffix(i) for i in want]
        for r in range(1, n):
            a, b = suffix(order[r - 1]), suffix(order[r])
            common = 0
            while common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            assert lcp[r] == max(0, common - 1)


def test_quality_rules(corpus, empty):
    rows, df = corpus
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == len(rows) and got[0]["size"] == "clash"
    for r in got:
        t, m = r["text"] or "", r["__mr_rules"]
        words = WORD.findall(t)
        assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
        assert m["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        assert m["n_repeat_words"] == windows(words, 8) and m["covered_words"] == windows(words, quality_rules.MIN_REPEAT)
        if len(words) < 1000:
            longest = max([k for k in range(1, len(words) + 1) if windows(words, k)], default=0) if len(words) < 150 else m["longest_repeat"]
            assert m["longest_repeat"] == longest
        failed = len(words) < 20 or 100 * m["n_repeat_words"] > 30 * len(words)
        assert m["base_failed"] == failed
        assert m["kept"] == (not failed and 100 * m["covered_words"] <= 40 * len(words) and m["longest_repeat"] <= 100)
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_stage(None, df, "").columns == df.columns


def test_word_cache_gives_the_tokenizer_ids():
    path = public_tokenizers.path(packing.VOCABULARY)
    plain, cached = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    rng = random.Random(1)
    signs = "ab' \n\t1.!é日 <|\x1c　\x85\x00"
    texts = ["", " a  b", "it's 'll we'd", "<|endoftext|> a <|endoftext|>b", "a\n\nb c ", "日本 語　x"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for text, ids in zip(texts, cached.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_differencing():
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 40):
        sizes = rng.integers(1, 257, 300).tolist()
        part = packing.differencing(sizes, k)
        sums = np.bincount(part, weights=sizes, minlength=k)
        assert len(part) == 300 and set(part) <= set(range(k)) and sums.max() - sums.min() <= max(sizes) / 4
    assert packing.differencing([], 3) == []
    # 3 pieces of 600 do not fit two windows of 1024.
    assert len(set(packing.windows([600, 600, 600], 1024))) == 3


def test_packing(corpus, empty):
    rows, df = corpus
    pieces = packing.pack(df).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t or "")
    assert by_doc.keys() == texts.keys()
    for i, ts in texts.items():
        want = Counter()
        for t in ts:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
            want[tuple(ids)] += 1
        if len(ts) == 1:
            got = b"".join(bytes(p["ids"]) for p in sorted(by_doc[i], key=lambda p: p["start"]))
            assert np.frombuffer(got, "<u4").tolist() == list(next(iter(want)))
        assert sum(p["length"] for p in by_doc[i]) == sum(len(k) * n for k, n in want.items())
    assert packing.pack(empty).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[name]()
            if fine:
                out.append((m.start(), k, name, m.end()))
    return sorted(out)


def test_personal_data(spark, corpus, empty):
    odd = ["a@b.co_x@d.e", "x@y.z@w.v a@b..c", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (234) 555-1234)", "日本 a@b.jp é 1.1.1.1", None, "", "1.1.1.1@x.y +1.1.1.1"]
    rng = random.Random(2)
    odd += ["".join(rng.choice("ab1234.@+-() é\n") for _ in range(60)) for _ in range(400)]
    seen = ["1.2.3.4", "1.2.3.5", "a@b.com", "+1 (234) 555-1234", "EMP-883-12", "7.7.7.7"]
    rows = list(enumerate(odd)) + [(9000 + i, f"some words my badge number {v} thanks") for i, v in enumerate(seen)]
    rows += [(9100, "the order EMP-999-77 is no badge"), (9101, "again EMP-883-12 here")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{n}:{s}:{e}" for s, _, n, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        for k in PLAIN:
            assert got[i][f"n_{k}"] == sum(n == k for _, _, n, _ in spans)
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    # The pattern "badge number" is confident; what it reveals is found elsewhere too.
    assert got[9004]["spans"] == "id:27:37" and got[9101]["spans"] == "id:6:16" and got[9100]["spans"] == ""
    assert pii.find_pii(corpus[1]).count() == len(corpus[0])
    assert pii.find_pii(empty).count() == 0


def labelled(spark, n=400):
    """Clean and bad texts with their labels."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(60)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            ws = [w + "***" for w in ws]
        if toxic:
            for at in (5, 25, 45):
                ws.insert(at, rng.choice(["idiot", "moron", "zzgrub"]))
        docs.append((i, " ".join(ws) + "."))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(10_000, None), (10_001, "")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def pii_contexts(words, first, last):
    """The patterns around words first to last, as tuples."""
    out = []
    if first >= 2:
        out.append(("two", words[first - 2], words[first - 1]))
    if first >= 1 and last + 1 < len(words):
        out.append(("around", words[first - 1], words[last + 1]))
    lead = re.match(r"(?:[^\w]|_)*", words[first]).group()
    if first >= 1 and lead:
        out.append(("signs", words[first - 1], lead))
    return out


def test_pii_context_is_of_the_whole_text(spark):
    far = "x" * 400
    texts = ["ab a@x.com; mail b@y.com or c@z.com,d@z.com", f"see code {far} AB12345 or CD67890 EF13579\n", "one AB12345", f" \n two {far}\tthree 10.0.0.1\n10.0.0.2 +1 555 123 4567 end 4111 1111 1111 1111 of GH24680 IJ12345", "", 'a b = "XY11223" c']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    n = 0
    for r in pii.entities(rows).collect():
        ws = list(WORD.finditer(texts[r["doc_id"]]))
        for i in r["items"]:
            at = [k for k, w in enumerate(ws) if w.end() > i["start"] and w.start() < i["end"]]
            want = [F.xxhash64(*map(F.lit, c)) for c in pii_contexts([w.group() for w in ws], at[0], at[-1])]
            got = spark.range(1).select(F.array(*want)).first()[0] if want else []
            assert (i["word"], i["patterns"]) == (at[0], got), (r["doc_id"], i)
            n += 1
    assert n == 15


def brute_discovery(texts):
    """The method in plain loops: believed values after the rounds."""
    word = re.compile(pii.WORD)
    key = re.compile(pii.KEY)
    total, entities_at = Counter(), []
    for t in texts:
        ws = list(word.finditer(t))
        names = [w.group() for w in ws]
        for k in range(len(ws)):
            total.update(pii_contexts(names, k, k) if k else [])
        seeds = [(s, e, t[s:e], 0) for s, _, _, e in base_spans(t)]
        for m in re.finditer(pii.TOKEN, t):
            if not any(s < m.end() and e > m.start() for s, e, _, _ in seeds):
                seeds.append((m.start(), m.end(), m.group(), 1 if key.match(m.group()) else 2))
        begins = Counter()
        for s, _, _, _ in seeds:
            begins[next(k for k, w in enumerate(ws) if w.start() <= s < w.end())] += 1
        for s, e, v, kind in seeds:
            at = [k for k, w in enumerate(ws) if w.end() > s and w.start() < e]
            entities_at.append((v, kind, 1 / begins[at[0]], pii_contexts(names, at[0], at[-1])))
    graph, kinds = {}, {}
    for v, kind, share, patterns in entities_at:
        kinds[v] = min(kind, kinds.get(v, 9))
        for p in patterns:
            graph.setdefault(p, Counter())[v] += share
        if kind:
            hexa = re.match(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}$", v)
            shape = f"hex{len(v)}" if hexa else re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", v)))
            graph.setdefault(("shape", shape), Counter())[v] += 1
    belief = {}
    while True:
        confident = {}
        for p, vs in graph.items():
            b = {v: 1.0 if kinds[v] < 2 else belief.get(v, 0.0) for v in vs}
            good = sum(b[v] * n for v, n in vs.items())
            bad = sum(vs.values()) - good if p[0] == "shape" else total[p] - sum(vs.values())
            if sum(x >= pii.LEAST_BELIEF for x in b.values()) >= pii.LEAST_INSTANCES and good / (good + bad) >= pii.LEAST_CONFIDENCE - 1e-9:
                confident[p] = good / (good + bad)
        fresh = {}
        for v, kind in kinds.items():
            if kind == 2:
                doubt = 1.0
                for p, vs in graph.items():
                    if v in vs and p in confident:
                        doubt *= max(1e-9, 1 - confident[p])
                if 1 - doubt >= pii.LEAST_BELIEF:
                    fresh[v] = 1 - doubt
        if sum(fresh.values()) <= sum(belief.values()) + pii.SETTLED:
            return set(belief)
        belief = fresh


def test_pii_rounds_against_plain_loops(spark):
    """Chains of discovery: seeds, a context, a shape, another context; a context that ordinary words fill too."""
    rng = random.Random(9)
    words = "stone river green walk light under quick seven paper glass".split()
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    texts = [f'{fill(4)} token = "{hexa(40)}" {fill(4)}' for _ in range(6)]
    texts += [f'{fill(3)} token = "{v}" {fill(3)}' for v in ("QX-771-20", "QX-772-21", "QX-773-22", "zz9_plural_77")]
    texts += [f"{fill(3)} badge of {v} here {fill(2)}" for v in ("QX-771-20", "QX-772-21", "QX-773-22", "new88ab1", "new99cd2")]
    texts += [f"{fill(3)} number {v} stands {fill(2)}" for v in ("1234567890123456", "QX-900-10", "1111-22", "word", "10.1.1.1", "7.7.7.7")]
    texts += [f"write {fill(1)} x{k}@mail.org {fill(3)} 12345{k}" for k in range(5)] + [fill(50), "", "AB12345"]
    found = brute_discovery(texts)
    assert {"QX-771-20", "zz9_plural_77", "QX-900-10", "new88ab1"} <= found and "1234567890123456" not in found
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    each = pii.entities(rows).select("rid", F.explode("items").alias("i")).select("rid", "i.*")
    assert {r["value"] for r in pii.discover(pii.stored(each), rows).collect()} == found
    spans = {r["doc_id"]: r for r in pii.find_pii(rows).collect()}
    for i, t in enumerate(texts):
        assert spans[i]["n_id"] == sum(v in t for v in found) and spans[i]["n_key"] == (i < 6)
        assert spans[i]["n_spans"] == len(spans[i]["found"])


def test_pii_finds_hidden_keys_by_context(spark):
    """At sf0.01 the context of the keys of one half reveals those of the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    each = pii.stored(pii.entities(docs)).select("rid", F.explode("items").alias("i")).select("rid", "i.*")
    is_key = F.col("kind") == pii.KINDS.index("key")
    hidden = each.withColumn("kind", F.when(is_key & (F.crc32("value") % 2 == 0), pii.KINDS.index("id")).otherwise(F.col("kind")))
    want = {r["value"] for r in each.filter(is_key & (F.crc32("value") % 2 == 0)).collect()}
    found = {r["value"] for r in pii.discover(hidden, docs).collect()}
    assert len(want) >= 3 and len(want & found) >= 0.9 * len(want)


def test_pii_finds_ids_in_plain_lists(spark):
    # Only one word lies between the last two ids; the pattern before CD67890 also stands before addresses.
    seeds = [f"write to m{k}@x.com ref AB12345 or n{k}@x.com and" for k in range(20)]
    rows = list(enumerate([*seeds, "mail ref AB12345 or CD67890 there"]))
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["spans"] for r in got}
    assert "id:20:27" in found[len(rows) - 1]


@pytest.mark.parametrize(("score", "place", "folds", "held", "least"), [(quality_classifier.score_quality, 1, 5, 0, 0.3), (toxicity.score_toxicity, 2, 3, 1, 0.7)])
def test_classifiers(spark, corpus, empty, score, place, folds, held, least):
    docs, labels, rows = labelled(spark)
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    truth = {r[0]: r[place] for r in rows}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    out = [(got[i]["predicted"], y) for i, y in truth.items() if got[i]["held_out"]]
    assert np.mean([p == y for p, y in out]) > 0.95
    assert got[10_000]["score"] == got[10_001]["score"]
    no_labels = labels.filter("false")
    assert score(corpus[1], no_labels).count() == len(corpus[0])
    assert score(empty, labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels, _ = labelled(spark, 100)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality_classifier.score_quality(docs, labels).orderBy("doc_id").collect()
    assert a == quality_classifier.score_quality(docs, flipped).orderBy("doc_id").collect()


def test_held_out_toxic_labels_are_not_learnt(spark):
    docs, labels, _ = labelled(spark, 150)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score_toxicity(docs, labels).orderBy("doc_id").collect()
    assert a == toxicity.score_toxicity(docs, flipped).orderBy("doc_id").collect()


def events(text):
    table, machine = toxicity.classes(), toxicity.grammar()
    found = []
    for clause in toxicity._CLAUSE.split(text.lower()):
        found += toxicity.matches_of([table.get(w, "o") for w in toxicity._WORD.findall(clause)], machine)
    return [k + m for k, m in found]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You are an idiot.", ["it"]),
        ("What an idiot", ["i"]),
        ("What an idiot he is", ["it"]),
        ("You are such an idiot", ["ist"]),
        ("You pathetic loser", ["it", "ist"]),
        ("You are not an idiot", ["int"]),
        ("I am an idiot", ["if"]),
        ("She said that you are an idiot", ["irt"]),
        ("You are an idiot, he said", ["irt"]),
        ("I will kill you", ["ht"]),
        ("we will kill them all", ["ht"]),
        ("kill yourself", ["ht"]),
        ("someone should shoot her", ["ht"]),
        ("You should be shot", ["pt"]),
        ("I will never hurt you", ["hnt"]),
        ("kill the lights", []),
        ("the sun hurt", []),
        ("they wrote it. idiot!", ["i"]),
    ],
)
def test_grammar(text, want):
    assert events(text) == want


def test_grammar_is_the_composition_of_its_transducers():
    rng = random.Random(4)
    machine = toxicity.grammar()
    words = [*toxicity.PLAIN, *[(k, "") for k in toxicity.KINDS]]
    for _ in range(300):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        step = clause
        for t in toxicity.FORWARD:
            step = t().run(step)
        assert machine[0].run(clause) == step
        step = step[::-1]
        for t in toxicity.BACKWARD:
            step = t().run(step)
        assert toxicity.matches_of(clause, machine) == [o for o in step[::-1] if isinstance(o, tuple)]


def test_toxicity_against_plain_scores(spark):
    """score is the logistic of the clauses' strongest matches under the learnt weights, text by text."""
    docs, labels, _ = labelled(spark, 200)
    kept = {}
    fit, learnt = toxicity.fit, toxicity.learnt_words
    patch = pytest.MonkeyPatch()
    patch.setattr(toxicity, "fit", lambda *a: kept.setdefault("w", fit(*a)))
    patch.setattr(toxicity, "learnt_words", lambda s: kept.setdefault("words", learnt(s)))
    try:
        got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    finally:
        patch.undo()
    table, machine = toxicity.classes(kept["words"][2]), toxicity.grammar()
    for r in docs.collect():
        clauses = toxicity._CLAUSE.split((r["text"] or "").lower())
        n_words = sum(len(toxicity._WORD.findall(c)) for c in clauses)
        count, kinds = Counter(), Counter()
        for c in clauses:
            ms = toxicity.matches_of([table.get(w, "o") for w in toxicity._WORD.findall(c)], machine)
            if ms:
                best = max(ms, key=lambda m: (toxicity.EVENT_PRIOR[toxicity.EVENTS.index(m)], -toxicity.EVENTS.index(m)))
                count[best] += 1
                kinds.update(m[0] for m in ms)
        x = [count[e] for e in toxicity.EVENTS] + [100 * kinds[k] / max(1, n_words) for k in toxicity.KINDS]
        z = sum(w * np.log1p(v) for w, v in zip(kept["w"], x)) + kept["w"][-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_quality_against_plain_dot_products(spark):
    """score is the logistic of a text's n-gram shares with the learnt weights, n-gram by n-gram."""
    docs, labels, _ = labelled(spark, 100)
    kept = {}
    train = quality_classifier.train
    patch = pytest.MonkeyPatch()
    patch.setattr(quality_classifier, "train", lambda *a: kept.setdefault("w", train(*a)))
    try:
        got = {r["doc_id"]: r["score"] for r in quality_classifier.score_quality(docs, labels).collect()}
    finally:
        patch.undo()

    def mix(*parts):
        h = 0x51ED27
        for p in parts:
            h = (h ^ p) * 0x9E3779B97F4A7C15 % (1 << 64)
            h ^= h >> 29
        return h

    for r in docs.collect():
        ws = [quality_classifier._word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())]
        grams, seen = [], set()
        for k, (core, shape) in enumerate(ws):
            grams += [mix(core), mix(shape)]
            if k:
                grams += [mix(ws[k - 1][0], core), mix(ws[k - 1][1], shape)] + [11] * (ws[k - 1][0] == core)
            if k > 1:
                three = (ws[k - 2][0], ws[k - 1][0], core)
                grams += [12] * (three in seen)
                seen.add(three)
        mask = (1 << quality_classifier.BITS) - 1
        z = quality_classifier.SCALE / max(1, len(ws)) * sum(kept["w"][(h ^ h >> 32) & mask] for h in grams) + kept["w"][-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
