"""Word tables, collocations and the filter audit against brute-force versions."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from staywide.llm import audit, blocks, collocations, wordtable

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, word string, words int"
TEXTS = [
    "The cat sat on the mat, and the dog's bowl isn't here.  Two  spaces\n\nand\ttabs \r\n end ",
    "a <|endoftext|> b<|endoftext|><|endoftext|> <|endoftext",
    "<|endoftext|>",
    "漢字とかな交じり文 ▁ ééé 😀😀 ̀  x y <s> </s>",
    "new letters ࡰࡱ Ɤ1 \U0001e4d0\U00031350 end",
    "cut\x00here<|endoftext|>\x00",
    None,
    "",
    " \n\t ",
    "x" * 30000,
    " ".join(f"word{i} thing" for i in range(20000)),
    "'s 't 'RE 're'll ?! 123abc",
]


def frame(spark, texts, langs=itertools.repeat("en"), ids=None):
    rows = [(i if ids is None else ids[i], t, lang, "p", "w", 1) for i, (t, lang) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------ distinct-word table


def by_library(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return ids, decoded


def test_word_table_gives_the_librarys_ids(spark):
    ids = [None if i == 3 else i for i in range(len(TEXTS))]
    docs = frame(spark, TEXTS, ids=ids).union(frame(spark, TEXTS[:1]))
    found = wordtable.encode_documents(docs, ids=True).collect()
    want = []
    for i, text in [*zip(ids, TEXTS), (0, TEXTS[0])]:
        tokens, decoded = by_library(text)
        want.append((i, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tokens))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert wordtable.encode_documents(docs.limit(0)).count() == 0


def test_word_table_over_small_blocks_and_random_texts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    rng = random.Random(5)
    alphabet = "ab  \n'st19.é漢<|endoftext|>ࡰ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) + rng.choice(["", "<|endoftext|>"]) for _ in range(200)]
    got = {r["doc_id"]: r["ids"] for r in wordtable.encode_documents(frame(spark, texts).repartition(3), ids=True).collect()}
    assert got == {i: by_library(t)[0] for i, t in enumerate(texts)}


def test_blocks_do_not_follow_keys(spark, monkeypatch):
    """Rows of one id and text, a third of a table, are dealt over blocks like all others."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    rows = frame(spark, ["same text " * 10] * 300, ids=[7] * 300)
    packed = blocks.coded(rows.select(F.lit("").alias("part"), F.split("text", " ").alias("words"), "doc_id"), "doc_id long", "test-blocks")
    sizes = [r["n"] for r in blocks.rows_of(packed, "doc_id").groupBy("block").agg(F.sum(F.size("lengths")).alias("n")).collect()]
    assert sum(sizes) == 300 and max(sizes) < 30


def test_decoding_by_join(spark):
    texts = [t for t in TEXTS if t]
    rows = [(i, by_library(t)[0]) for i, t in enumerate(texts)]
    rows += [(None, None), (100, []), (101, [222, 50256, 999999, 5]), (101, [161, 222, 64])]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = wordtable.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    want = [(i, tokenizer.decode(ids or [], skip_special_tokens=False)) for i, ids in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        wordtable.load(public_tokenizers.path("word_bpe_49k.json"))


# ------------------------------------------------------------------ collocations


def brute_collocations(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    inside = Counter()
    for (lang, words), a in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = lang, words[i : i + k]
                inside[part] = max(inside[part], a)
    rows = []
    for (lang, words), a in often.items():
        if inside[lang, words] >= a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((Fraction(1000 * a * n[lang], left * right).__floor__(), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, -score, -a, " ".join(words).encode(), left, right, n[lang]))
    out = []
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        out += [(r[0], i + 1, r[3].decode(), -r[2], *r[4:], -r[1]) for i, r in enumerate(list(group)[:top])]
    return out


def made_up(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "b", "É", "x.y", "no", "end!", " ", "漢"]
    passage = " ".join(rng.choice(["p%d" % i for i in range(40)]) for _ in range(60))
    texts = []
    for i in range(docs):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        words.insert(len(words) // 2, rng.choice([passage, "a b a b a b a b a b", "", "one, two; three\nfour"]))
        texts.append(" ".join(words))
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    return texts + [None, "", " \t\n"], langs + ["en", "xx", None]


@pytest.mark.parametrize("seed,least,top,small", [(1, 4, 2000, False), (2, 3, 15, True), (3, 100, 10, False)])
def test_collocations(spark, monkeypatch, seed, least, top, small):
    if small:
        monkeypatch.setattr(blocks, "BLOCK_BYTES", 700)
    texts, langs = made_up(seed)
    docs = frame(spark, texts, langs).repartition(3)
    docs = docs.union(docs.limit(0))
    found = [tuple(r) for r in collocations.collocations(docs, least, top).orderBy("lang", "rank").collect()]
    assert found == brute_collocations(list(zip(langs, texts)), least, top)
    assert collocations.collocations(docs.limit(0), least, top).count() == 0


def test_flow_gives_the_counts_of_all_shorter_grams(spark):
    texts, langs = made_up(9)
    docs = frame(spark, texts, ["en"] * len(texts))
    flow = collocations.flows(collocations.graph(docs, 1))
    for k in range(1, 6):
        want = Counter()
        for text in texts:
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                own = re.findall(r"[^\x20\x09]+", piece)
                want.update(" ".join(own[i : i + k]) for i in range(len(own) - k + 1))
        assert {r["gram"]: r["n"] for r in flow[k].collect()} == want


def test_passages_are_the_unary_paths(spark):
    passage = [f"w{i}" for i in range(300)]
    texts = ["x " + " ".join(passage) + " y"] * 5 + [" ".join(passage[100:150])] * 2 + ["r s t u r s t u r s t u"] * 3
    flow = collocations.flows(collocations.graph(frame(spark, texts), 1))
    found = {(r["passage"], r["n"]) for r in collocations.passages(flow[5], flow[4]).collect()}
    whole = ["x", *passage, "y"]
    assert {(" ".join(whole[:105]), 5), (" ".join(whole[101:151]), 7), (" ".join(whole[147:]), 5)} <= found
    # No path leads through the node where pieces begin and end, so the ring is cut there.
    assert ("r s t u r s t u", 6) in found and len(found) == 4


# ------------------------------------------------------------------ filter audit


def brute_audit(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    kinds = {k: {i for i, *v in labels if i is not None and v[j] == 1} for j, k in enumerate(("quality", "toxic"))}
    documents = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = WORDS.findall(text)
        failed = set()
        if len(words) < 100:
            failed.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if i is not None and i > first[text]:
            failed.add("E")
        documents.append((lang or "", failed, i in kinds["quality"], i in kinds["toxic"]))
    out = []
    for part in {d[0] for d in documents}:
        own = [d for d in documents if d[0] == part]
        removed_by, rows_of_part = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(removed)
                failing = sum(f in d[1] for d in own)
                rows_of_part.append((f, (part, "".join(order), step + 1, len(left), len(removed), failing - len(removed), sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed))))
        out += [(*row, removed_by[f]) for f, row in rows_of_part]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(3)
    texts = [None, "", "", "A B", "#", "x" * 5000]
    for _ in range(150):
        words = [rng.choice(["a", "B", "#", "Ccc", "dd"]) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 160))]
        texts.append(" ".join(words))
    texts += rng.choices(texts, k=100) + [texts[10]] * 400
    ids = [rng.choice([None, i, i, i, rng.randrange(50)]) for i in range(len(texts))]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), "p", "w", 1) for i, t in zip(ids, texts)]
    rows += rows[:20]
    labels = [(rng.choice([None, i]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), 1) for i in rng.choices(range(300), k=200)]
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part int")
    found = sorted(tuple(r) for r in audit.audit(docs, marked).collect())
    assert found == brute_audit(rows, [r[:3] for r in labels])
    assert audit.audit(docs.limit(0), marked).count() == 0 and audit.audit(docs, marked.limit(0)).count() == len(found)


def test_carry_save_counts_every_bit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 1000):
        words = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        times = rng.integers(1, 50, n)
        got = audit.popcounts(audit._planes(words, times))
        assert got.tolist() == [int(sum(t for w, t in zip(words.tolist(), times.tolist()) if w >> s & 1)) for s in range(32)]


def test_audit_folds_copies_and_counts_parts_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD", 3)
    rows = [(i, "same" if i % 2 else f"text {i}", f"part {i % 10}", "p", "w", 1) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.failures(docs, labels).count() < 200
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == brute_audit(rows, [])
