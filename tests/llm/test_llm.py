"""The training-data operators against brute force, exact round trips and the defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, shard string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, src, 0, "x", "y") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Random prose with exact and near copies, shared passages, repeated lines, odd and empty texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(600)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out = [" ".join(prose(rng.choice([1, 3, 6, 40, 120, 300]))) for _ in range(120)]
    base = prose(150)
    passage = prose(60)
    for k in range(30):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(150)] = "edited"
        out.append(" ".join(near))
        out.append(" ".join(prose(70) + passage + prose(40)))
    out += [out[3]] * 9 + ["", "", None, " \n ", "é" * 400, "one line\n" * 80, "x" * 5000, "<|endoftext|> a <|endoftext|>", "a  b\n\n c \t d's  ", "word " * 9000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None, "s3"][min(3, i % 7)]) for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s0"), (5, texts[5], "en", "s0"), (5, texts[5], "en", "s0")]
    return frame(spark, rows).persist()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def same_rows(df):
    return [r.asDict() for r in df.collect()]


def test_sharding(docs, none):
    from fidelis.llm.sharding import best_fit_decreasing, pack, shard

    rows = same_rows(shard(docs, shards=6))
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(6)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    homes = defaultdict(set)
    for r in rows:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())
    for r in docs.select("doc_id", "text").collect():
        t = (r["text"] or "").encode()
        assert (zlib.crc32(t), len(t) + 8) in homes
    assert shard(none).count() == 0
    rng = random.Random(1)
    items = [(rng.randint(1, 90), i) for i in range(400)]
    placed, total = pack(items, 7), [0] * 7
    for n, i in items:
        total[placed[i]] += n
    assert max(total) - min(total) <= 5
    # the tree picks the tightest bin, as a scan does
    order = sorted(items, key=lambda x: -x[0])
    bins, want = [], []
    for n, _ in order:
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: (bins[b], b), default=None)
        if fit is None:
            bins.append(100)
            fit = len(bins) - 1
        bins[fit] -= n
        want.append(fit)
    assert best_fit_decreasing(order, 100) == want


def test_toxicity(spark, none):
    from fidelis.llm.toxicity import char_model, drop_toxic, fit, restore, score

    rng = random.Random(2)
    words = ["the", "house", "river", "green", "walks", "under", "light", "table", "clear", "stone"]
    disguise = ["stupid", "st00pid", "stuuuupid", "s t u p i d", "stup1d"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = [rng.choice(words) for _ in range(30)]
        if bad:
            t[rng.randrange(30)] = "stupid" if i < 400 else disguise[i // 5 % 5].replace("00", "u")
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None), (1001, "", None, None)]
    d, lab = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = fit(d, lab)
    got = {r["doc_id"]: r["score"] for r in score(d, model).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and len(got) == len(rows)
    assert sum((got[i] >= 0.3) == (i % 5 == 0) for i in range(600)) >= 596
    kept = drop_toxic(d, lab)
    assert kept.columns == d.columns and 470 <= kept.count() <= 486
    assert restore("stuuuupid", model["costs"]) == "stupid" and restore("s t u p i d", model["costs"]).replace(" ", "") == "stupid"
    assert restore("stup1d", model["costs"]) == "stupid"
    assert score(none, fit(none, lab)).count() == 0 and char_model(none).shape == (64, 64, 64)


def test_chat(spark):
    from fidelis.llm import chat

    said = "<|im_end|><|im_start|>assistant ok & &lt;| &amp;lt;|"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "b\n\n"), (2, 0, "assistant", ""), (2, 0, "assistant", "x"), (None, 4, "us\ner", "né"), (None, None, None, "z")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    back = {r["tree"]: r for r in chat.read_back(chat.chosen_conversations(chat.conversations_as_trees(conv)), ["tree"]).collect()}
    for key in (1, 2, None):
        turns = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == key), key=lambda r: r)
        assert [(t["role"], t["text"]) for t in back[key]["turns"]] == [(r, x) for _, r, x in turns]
        assert back[key]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
    # a tree: 1 -> 2 -> 3, 2 -> 4 -> 5; the branch over 4 and 5 has the higher mean
    nodes = spark.createDataFrame([(9, 1, None, "user", "a", 1.0), (9, 2, 1, "assistant", "b", 1.0), (9, 3, 2, "user", "c", 0.0), (9, 4, 2, "user", "d", 5.0), (9, 5, 4, "assistant", "e", 5.0), (8, 7, 99, "user", "orphan", 1.0)], "tree long, node long, parent long, role string, text string, score double")
    top = {(r["tree"], r["branch"]): r["formatted"] for r in chat.chosen_conversations(nodes, top=2).collect()}
    assert re.findall(r"\n([a-z]+)<", top[9, 1]) == ["a", "b", "d", "e"] and re.findall(r"\n([a-z]+)<", top[9, 2]) == ["a", "b", "c"]
    assert set(top) == {(9, 1), (9, 2), (8, 1)}
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 1, 0.0)], "tree long, node long, parent long, score double"))
    assert chat.chosen_conversations(chat.conversations_as_trees(conv.limit(0))).count() == 0


def reference_lzw(data, least, rng):
    """A plain LZW encoder that clears its table at random once it is full."""
    clear, bits = 1 << least, []
    put = lambda c, w: bits.extend((c >> i) & 1 for i in range(w))
    fresh = lambda: ({bytes([i]): i for i in range(clear)}, clear + 2, least + 1)
    book, size, width = fresh()
    put(clear, width)
    cur = b""
    for v in data:
        b = bytes([v])
        if cur + b in book:
            cur += b
            continue
        put(book[cur], width)
        if size < 4096:
            book[cur + b] = size
            size += 1
            width += size - 1 == 1 << width and width < 12
        elif rng.random() < 0.3:
            put(clear, width)
            book, size, width = fresh()
        cur = b
    if cur:
        put(book[cur], width)
        size += 1
        width += size - 1 == 1 << width and width < 12
    put(clear + 1, width)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def test_gif(docs, none):
    from fidelis.llm import gif

    rng = random.Random(3)
    for least in (2, 3, 8):
        for n in (1, 2, 300, 20000):
            for alphabet in (1, 2, 1 << least):
                data = bytes(rng.randrange(alphabet) for _ in range(n))
                assert gif.lzw_decode(reference_lzw(data, least, rng), least, n).tobytes() == data
    # two frames: a transparent entry over a local palette, restored to the picture before
    def block(least, data):
        raw = reference_lzw(data, least, rng)
        return bytes([least]) + b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"

    head = b"GIF89a" + bytes([2, 0, 2, 0, 0xF0, 0, 0]) + bytes([255, 0, 0, 0, 255, 0])
    one = b"\x2c" + bytes([0, 0, 0, 0, 2, 0, 2, 0, 0]) + block(2, bytes([0, 1, 1, 0]))
    two = b"\x21\xf9\x04" + bytes([(3 << 2) | 1, 7, 0, 1]) + b"\0" + b"\x2c" + bytes([0, 0, 1, 0, 2, 0, 1, 0, 0x80]) + bytes([0, 0, 255, 9, 9, 9]) + block(2, bytes([0, 1]))
    _, _, frames = gif.decode(head + one + two + one + b"\x3b")
    assert frames[1]["canvas"][1].tolist() == [[0, 0, 255, 255], [255, 0, 0, 255]] and frames[1]["delay"] == 7
    assert (frames[2]["canvas"] == frames[0]["canvas"]).all()
    rows = {r["doc_id"]: r for r in gif.gif_features(gif.texts_to_gif(docs)).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        raw_padded = raw + b" " * (192 if not raw else -len(raw) % 192)
        got = rows[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(raw_padded), hashlib.sha256(raw_padded).hexdigest(), zlib.crc32(raw_padded[-16:]))
        assert sum(got["colour_histogram"]) == len(raw_padded)
    assert gif.gif_features(gif.texts_to_gif(none)).count() == 0


def test_language_id(spark, none):
    from fidelis.llm import langid

    path = langid.default_vocabulary()
    rng = random.Random(5)
    sounds = {"aa": ["the", "ing", "sh", "er"], "bb": ["que", "ción", "os", "ez"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(["aa", "bb"][i % 2]) for _ in range(25)), ["aa", "bb"][i % 2], "s") for i in range(80)]
    d = frame(spark, [*rows, (100, None, None, None), (101, "", None, None), (102, "12 34!", None, None), (103, "ing" * 4000, None, None)])
    model = langid.fit(d, path)
    got = {r["doc_id"]: r for r in langid.predict(d, model, path).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang, _ in rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert langid.predict(none, langid.fit(none, path), path).count() == 0
    # the forward sums are the sums over all segmentations
    pieces, probs = langid.pieces(path), model[1]
    names = {}
    for n in range(1, 6):
        for w in ("thing", "sher"):
            for i in range(len(w) + 1):
                s = ("▁" + w)[i : i + n]
                if len(s) == n:
                    k = int(pieces.numbers(np.array([langid.Pieces.key(s)], np.uint64))[0])
                    names[s] = k if k or n == 1 else None

    def total(s, lang):
        return 1.0 if not s else sum(probs[names[s[:m]], lang] * total(s[m:], lang) for m in range(1, min(5, len(s)) + 1) if names.get(s[:m]) is not None)

    logs = langid.log_probs(["thing", "sher"], path, probs)
    for k, w in enumerate(("thing", "sher")):
        longer = [m for m in range(6, len(w) + 2)]  # pieces of six characters would be missed above
        if all(int(pieces.numbers(np.array([langid.Pieces.key(("▁" + w)[i : i + m])], np.uint64))[0]) == 0 for m in longer for i in range(len(w) + 2 - m)):
            assert np.exp(logs[k]) == pytest.approx([total("▁" + w, g) for g in range(2)], rel=1e-9)


def mixed(rows, weights=(5, 2, 1), ceiling=3):
    """Targets by repeated resharing."""
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(size.values())), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * share > ceiling * size[s]}
        if not full:
            return target | {s: w[s] * share for s in free}
        for s in full:
            target[s] = float(ceiling * size[s])
            left -= target[s]
        free -= full
    return target


def test_mixing(docs, none):
    from fidelis.llm.mixing import mix

    rows = same_rows(mix(docs))
    assert len(rows) == docs.count()
    want, taken, size = mixed(rows), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] = max(size[r["source"]], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= size[s]
    assert rows and sorted(map(str, rows)) == sorted(map(str, same_rows(mix(docs))))
    half = {r["doc_id"]: r["taken"] for r in same_rows(mix(docs, budget=0.5, ceiling=1))}
    assert all(half[r["doc_id"]] <= r["taken"] for r in same_rows(mix(docs, budget=0.9, ceiling=1)))
    assert mix(none).count() == 0


def test_exact_dedup(docs, none):
    from fidelis.llm.exact_dedup import exact_dedup, keep_first_copies

    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    for how in ({}, {"salts": 1}, {"salts": 64}):
        rows = same_rows(exact_dedup(docs, **how))
        assert len(rows) == docs.count()
        kept = defaultdict(int)
        for r in rows:
            ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
            real = [i for i in ids if i is not None]
            assert r["group_size"] == len(ids) and r["keep_id"] == (max(real) if real else None)
            kept[r["text_sha256"]] += r["kept"]
        assert set(kept.values()) == {1}
    out = keep_first_copies(docs)
    assert out.columns == docs.columns and sorted(r["text"] or "" for r in out.collect()) == sorted(groups)
    assert keep_first_copies(none).count() == 0


def test_a_task_emits_one_row_per_text(spark):
    from pyspark.sql import functions as F

    from fidelis.llm.exact_dedup import winners

    rows = spark.range(4000).repartition(6).select(F.col("id").alias("_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("_t")).withColumn("_d", F.unhex(F.sha2("_t", 256)))
    df = winners(rows, 8)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    wrote, at = [], [plan]
    while at:
        node = at.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            wrote.append(node.metrics().apply("shuffleRecordsWritten").value())
        at += [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            at.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            at.append(node.plan())
    assert sorted(r["group_size"] for r in df.collect()) == [800] * 5
    # the deal to six tasks, then at most one row for each of five texts and six tasks, then one for each text and salt
    assert 4000 in wrote and sum(w for w in wrote if w < 4000) <= 30 + 30 + 5


def brute_links(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    near = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                near[i].add(j)
                near[j].add(i)
    return near


@pytest.mark.parametrize("limit", [64, 4])
def test_ngram_join(docs, none, limit):
    from fidelis.llm.ngram_join import jaccard_join, one_of_each

    rows = docs.collect()
    near, label = brute_links(rows), list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    want = sorted(((r["doc_id"], len(near[i]), min((rows[j]["doc_id"] for j in range(len(rows)) if label[j] == label[i] and rows[j]["doc_id"] is not None), default=None)) for i, r in enumerate(rows)), key=str)
    got = sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard_join(docs, limit=limit).collect()), key=str)
    assert got == want
    if limit == 64:
        out = one_of_each(docs)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {w[2] for w in want}
        assert jaccard_join(none).count() == 0


def test_bpe(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from fidelis.llm import bpe

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in bpe.encode_corpus(docs, with_ids=True).collect():
        got[r["doc_id"]].append(r)
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        x = got[r["doc_id"]].pop()
        assert x["ids"] == ids and x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_corpus(none).count() == 0
    # any cuts give the same ids
    encode, _ = bpe.codec(bpe.default_ranks())
    rng, alphabet = random.Random(6), ["a", "b", " ", "  ", "\n", "é", "1", "'s", "\t", "don't", "!!", " ", "x" * 20, "\x1c", "日本"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        at = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randint(0, 8)))})
        parts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        assert bpe.stitch(parts, lambda i, p=parts: encode(p[i]), encode) == encode(text)


def test_passages(docs, none):
    from fidelis.llm import passages as p

    # windows against their definition
    rng = np.random.default_rng(8)
    for n, width in ((60, 7), (30, 30), (5, 9), (200, 12)):
        h, owner = rng.integers(0, 1 << 63, n, dtype=np.uint64), np.sort(rng.integers(0, 3, n))
        got = set(zip(*(x.tolist() for x in p.compact_windows(h, owner, width)), strict=True))
        want = set()
        for c in range(n):
            a = b = c
            while a > 0 and owner[a - 1] == owner[c] and h[a - 1] > h[c]:
                a -= 1
            while b < n - 1 and owner[b + 1] == owner[c] and h[b + 1] > h[c]:
                b += 1
            if b - a + 1 >= width:
                want.add((c, a, b))
        assert got == want
    at, words = defaultdict(set), {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            w = words[r["doc_id"]] = WORD.findall((r["text"] or "").lower())
            for k in range(len(w) - 50):
                at[tuple(w[k : k + 51])].add(r["doc_id"])
    true = {i for v in at.values() if len(v) > 1 for i in v}
    rows = p.passages(docs).collect()
    found = {r["doc_id"] for r in rows}
    assert true <= found
    # whoever shares no 51 words exactly has a near-duplicate passage, by comparing all passages of 51 words and more of both texts
    grams = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in words.items()}

    def near(i, j, start, end, low, high):
        a, b = set(grams[i][start : end - 4]), set(grams[j][low : high - 4])
        return len(a & b) / len(a | b)

    for r in rows:
        assert r["jaccard"] == pytest.approx(near(r["doc_id"], r["match_doc_id"], r["start_word"], r["end_word"], r["match_start"], r["match_end"])) and r["jaccard"] >= 0.8
    assert len(found - true) <= 1
    covered = defaultdict(set)
    for r in rows:
        assert r["end_word"] - r["start_word"] >= 51 and r["jaccard"] >= 0.8 and r["doc_id"] != r["match_doc_id"]
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    # a passage is matched with chosen documents, of which one may share a word less at its end than another one
    exact = {(i, j) for i, w in words.items() for k in range(len(w) - 50) if len(at[tuple(w[k : k + 51])]) > 1 for j in range(k, k + 51)}
    assert sum(j in covered[i] for i, j in exact) >= 0.995 * len(exact)
    assert p.passages(none).count() == 0


def test_passages_with_edited_words(spark):
    """Passages just over the similarity, with one to four edited words: a pair of documents each, the shortest of 51 words."""
    from fidelis.llm import passages as p

    assert p.functions_needed(0.8, 2, 0.97) == 4 and p.functions_needed(0.8, 2, 0.99) == 5
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    while len(rows) < 160:
        i, edits = len(rows), len(rows) // 2 % 4 + 1
        one = prose(45 * edits + 6)
        two = list(one)
        for j in rng.sample(range(1, len(one) - 1), edits):
            two[j] = "edited"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (one, two))
        if len(a & b) >= 0.8 * len(a | b):
            rows += [(i + k, " ".join(prose(60) + x + prose(60)), "en", "s") for k, x in enumerate((one, two))]
    got = {(r["doc_id"], r["match_doc_id"]) for r in p.passages(frame(spark, rows)).collect()}
    found = [sum((i, i + 1) in got for i in range(0, 160, 2) if i // 2 % 4 == k) for k in range(4)]
    assert min(found) >= 19 and sum(found) >= 79 and all(a // 2 == b // 2 for a, b in got)


def test_pipeline(spark, tmp_path):
    import shutil

    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet").withColumn("extra", F.lit(1))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, src)
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        if name != "mixing":
            assert kept.count() == kept.select("doc_id").distinct().count() and kept.join(before, "doc_id", "left_anti").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, src).collect()
    assert sum(r["copies"] for r in last) == kept.count() and all(len(r["ids"]) == r["n_tokens"] for r in last)
    assert corpus_pipeline.run(spark, src).count() == len(last)
    shutil.rmtree(tmp_path, ignore_errors=True)
