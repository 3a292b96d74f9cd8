"""Decontamination, URL rules and models, fingerprints and chats, without Python on the main path."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chatlens.llm import chat_format, decontaminate, fingerprints, queries, url_filter

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def in_the_jvm(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "ArrowEval", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoop"))


# --- decontamination -----------------------------------------------------------------


def brute_hits(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        size = min(len(words), 10)
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k : k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (own := tuple(words[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[own]
        yield i, len(words), len(hit), sorted(found)


def found_hits(documents, benchmark):
    rows = decontaminate.find_contamination(documents, benchmark).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, " ".join(f"word{i % 97} und{i % 31} été{i % 13}" for i in range(5, 9))),
        (2, "two words"),
        (2, "an idiot"),
        (3, "ab"),
        (4, None),
        (5, " ?! "),
        (6, "one two three four five six seven"),
        (7, "ab " * 12),
        (None, "you are an idiot and"),
    ]
    return spark.createDataFrame([(*r, "k", "w") for r in rows], "item_id bigint, text string, key string, window string")


@pytest.mark.parametrize("rows", [0, 200_000])
def test_hits_of_odd_documents(odd_documents, no_documents, items, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    given = [(r.doc_id, r.text) for r in odd_documents.collect()]
    wanted = [(r.item_id, r.text) for r in items.where("item_id IS NOT NULL").collect()]
    named = items.where("item_id IS NOT NULL")
    assert found_hits(odd_documents, named) == sorted(brute_hits(given, wanted), key=str)
    assert found_hits(no_documents, items) == []
    assert all(not r[2] for r in found_hits(odd_documents, items.limit(0)))


def test_hits_of_documents(spark):
    documents, benchmark = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    given = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = [(r.item_id, r.text) for r in benchmark.collect()]
    assert found_hits(documents, benchmark) == sorted(brute_hits(given, wanted), key=str)


def test_contaminated_documents_go(odd_documents, items):
    left = decontaminate.decontaminate(odd_documents, items)
    assert left.columns == odd_documents.columns
    dirty = decontaminate.find_contamination(odd_documents, items).where("n_hit > 0").count()
    assert 0 < dirty and left.count() == odd_documents.count() - dirty


# --- URLs ----------------------------------------------------------------------------

URLS = {
    "https://A.Example.ORG/en/77?x#y": ("a.example.org", "/en/77", "org/", "allow"),
    "https://a.example.org/en/177": ("a.example.org", "/en/177", "example.org/en/1", "block"),
    "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
    "http://example.com/de/x": ("example.com", "/de/x", "com/de/", "block"),
    "ftp://x.com/fr/a#?": ("x.com", "/fr/a", "com/fr/", "allow"),
    "http://x.net?u=http://y.org/": ("x.net", "", None, None),
    "no scheme.org/": ("", "", None, None),
    "://": ("", "", None, None),
    None: ("", "", None, None),
    "x://org": ("org", "", None, None),
}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id int, url string, host string, verdict string")
    rows = url_filter.judge(pages, queries.URL_RULES).orderBy("page_id").collect()
    for row, (host, path, rule, verdict) in zip(rows, URLS.values()):
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_scores_are_those_of_two_models(spark):
    rows = [("a.net", "/good/one", True, 3), ("b.net", "/good/two", True, 1), ("c.net", "/bad/one", False, 2)]
    labelled = spark.createDataFrame(rows, "host string, path string, accepted boolean, n bigint")
    model = url_filter.train(labelled)
    counts = [Counter(), Counter()]
    pad = "\x02" * url_filter.ORDER

    def grams(url):
        held = pad + url + "\x03"
        return [held[k : k + url_filter.ORDER + 1] for k in range(len(held) - url_filter.ORDER)]

    for host, path, accepted, n in rows:
        for gram in grams(host + path):
            for order in range(url_filter.ORDER + 1):
                counts[accepted][gram[url_filter.ORDER - order :]] += n
                counts[accepted][("all", gram[url_filter.ORDER - order : -1], order)] += n

    def probability(side, gram):
        p = 1 / url_filter.ALPHABET
        for order in range(url_filter.ORDER + 1):
            whole = counts[side][("all", gram[url_filter.ORDER - order : -1], order)]
            p = (counts[side][gram[url_filter.ORDER - order :]] + url_filter.BACKOFF * p) / (whole + url_filter.BACKOFF)
        return p

    urls = [("a.net", "/good/three"), ("d.net", "/bad/two"), ("", ""), ("日本", "/?")]
    frame = spark.createDataFrame(urls, "host string, path string")
    for row in url_filter.score(frame, model).collect():
        own = grams(row.host + row.path)
        mean = sum(math.log(probability(True, g)) - math.log(probability(False, g)) for g in own) / len(own)
        assert row.score == pytest.approx(mean, abs=1e-5)


def test_threshold_parts_the_kinds(spark):
    rows = [(0.5, True, 3), (0.1, True, 1), (-0.2, False, 5), (-0.9, False, 1)]
    scored = spark.createDataFrame(rows, "score double, accepted boolean, n bigint")
    assert -0.2 < url_filter.calibrate(scored) <= 0.1
    assert url_filter.calibrate(scored.where("accepted")) == 0.0
    assert url_filter.calibrate(scored.limit(0)) == 0.0


def test_characters_and_models_are_not_broadcast(spark, monkeypatch):
    """Spark takes either for as large as compressed files, and those have a row for each URL, not for each character."""
    made, cut, calibrate = [], url_filter.cut, url_filter.calibrate
    monkeypatch.setattr(url_filter, "cut", lambda frame: made.append(frame) or cut(frame))
    monkeypatch.setattr(url_filter, "calibrate", lambda frame: made.append(frame) or calibrate(frame))
    urls = [(i, f"http://www.example.{('org', 'com', 'net')[i % 3]}/{('en', 'es', 'fr', 'de')[i % 4]}/{i}") for i in range(600)]
    made.append(url_filter.judge(spark.createDataFrame(urls, "page_id int, url string"), queries.URL_RULES))
    plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in made]
    assert [p.count("SortMergeJoin") for p in plans] == [0, 0, 4, 4]  # distinct URLs, model, held-back URLs, verdicts
    assert not any("Broadcast" in p for p in plans)


# --- fingerprints --------------------------------------------------------------------


def test_fingerprints_are_rightmost_least_grams(spark):
    text = " ".join(f"w{(i * i) % 23}" for i in range(80))
    frame = spark.createDataFrame([(text,), ("a a a a a a a a a a a a a a a a",), ("one two",), ("",), (None,)], "text string")
    rows = fingerprints.with_fingerprint(frame, "text", "f")
    hashed = frame.select("text", fingerprints._grams(fingerprints.words_of(F.col("text"))).alias("g"))
    for row, own in zip(rows.collect(), hashed.collect()):
        grams, wanted = own.g, []
        for k in range(max(1, len(grams) - fingerprints.WINDOW + 1) if grams else 0):
            window = grams[k : k + fingerprints.WINDOW]
            at = k + max(j for j, h in enumerate(window) if h == min(window))
            if at not in wanted:
                wanted.append(at)
        assert [(f.at, f.gram) for f in row.f] == [(at, grams[at]) for at in wanted]


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_edits_take_from_the_next_document(spark, bucket, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 3 <> 1")
    given = sorted((r.doc_id, r.text or "") for r in documents.collect())
    found = {r.doc_id: r for r in fingerprints.compare_with_edits(documents.repartition(7)).collect()}
    assert len(found) == len(given)
    for k, (i, text) in enumerate(given):
        after, quarter = given[(k + 1) % len(given)][1], len(text) // 4
        assert found[i].edited == text[: len(text) - quarter] + after[:quarter]
        assert found[i].n_chars == len(text) and 0 <= found[i].near_next <= 1
    assert sum(r.near_edited for r in found.values()) / len(found) > 0.5


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    rng, parts = random.Random(7), ["a", "b", "Cd", "é", "中文", "9", " ", " ", ". ", "\n", "-", "\x7f", "👍"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 3, 8, 20, 40, 80, 160]))) for _ in range(500)]
    texts += ["x" * 300, "中" * 200, " . " * 50, "w " * 200, None, "one two three four five"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {row.edited: row.edited_fingerprint for row in fingerprints.compare_with_edits(documents).collect()}
    whole = fingerprints.with_fingerprint(spark.createDataFrame([(text,) for text in found], "text string"), "text", "wanted")
    assert found == {row.text: row.wanted for row in whole.collect()} and len(found) > 300
    # Of a long text only the tail of the edited one is taken apart.
    long = spark.createDataFrame([(" ".join(map(str, range(1000))), 3000, " end")], "text string, stays int, end string")
    long = fingerprints.with_fingerprint(long, "text", "fingerprint", keep=True)
    seen = fingerprints._with_edited_fingerprint(long.withColumn("fingerprint_grams", F.transform("fingerprint_grams", lambda g: F.lit(5))), F.col("stays"), F.col("end"))
    assert {f.gram for f in seen.first().edited_fingerprint if f.at < 700} == {5}


def test_fingerprints_of_odd_documents(odd_documents, no_documents):
    compared = fingerprints.compare_with_edits(odd_documents)
    rows = compared.collect()
    assert len(rows) == odd_documents.count()
    long = [tuple((f.at, f.gram) for f in r.fingerprint) for r in rows if r.doc_id in (1, 2) and r.n_chars == rows[0].n_chars]
    assert len(set(long)) <= 1
    assert fingerprints.compare_with_edits(no_documents).count() == 0
    one = odd_documents.where("doc_id = 14")
    assert fingerprints.compare_with_edits(one).first().near_next == 1.0
    assert in_the_jvm(compared)


# --- chats ---------------------------------------------------------------------------

TRICKY = ["", "plain", "<|end|>", "<\\|end|><|turn|>", "a<", "<\\\\|x", "|>", "<|", "\\<|body|>\\", "</s>[INST] ok [/INST]", "<\\", "é<|é"]


def test_texts_come_back(spark):
    turns = [(k % 4, k // 4, "assistant" if k % 2 else text or None, text) for k, text in enumerate(TRICKY * 3)]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat_format.format_chats(frame.withColumn("parts", chat_format.text_part(F.col("text"))))
    for row in chat_format.read_chats(made).collect():
        own = sorted((t for t in turns if t[0] == row.conv_id), key=lambda t: (t[1], t[2] or "", t[3]))
        assert [(t.role, t.text) for t in row.turns] == [(t[2] or "", t[3]) for t in own]
        assert "".join(row.loss_texts) == "".join(t[3] for t in own if t[2] == "assistant")
        assert row.formatted.count("<|end|>") == row.formatted.count("<|body|>") == len(own)


def test_parts_become_placeholders_in_order(spark):
    rows = [
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 40)]),
        (1, 1, "assistant", [("text", "<|image|> no", None, None), (None, None, "c.pdf", None)]),
        (1, 2, "user", None),
        (None, 0, None, []),
    ]
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    made = {r.conv_id: r for r in chat_format.format_chats(frame).collect()}
    assert made[1].formatted == (
        "<|turn|>user<|body|>see <|part:image|><|part:audio|><|end|><|turn|>assistant<|body|><\\|image|> no<|part:document|><|end|><|turn|>user<|body|><|end|>"
    )
    assert [tuple(a) for a in made[1].attachments] == [("image", "a.png", 576), ("audio", "b.wav", 40), ("document", "c.pdf", 2048)]
    assert made[None].n_turns == 1
    under = [made[1].formatted.split("<|end|>")[k][m.skip : m.skip + m.take] for k, m in enumerate(made[1].loss_mask)]
    assert under == ["", "<\\|image|> no<|part:document|>", ""]
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_random_parts_come_back(spark):
    pick, bits = random.Random(11), ["<", "\\", "|", "end", "turn", "body", ">", "part:image", "é", ""]
    kinds = ["text"] * 6 + [None, "image", "audio", "document", "end", "turn", "body", "part:image", "a|>b", ""]
    part = lambda: (pick.choice(kinds), "".join(pick.choice(bits) for _ in range(pick.randint(0, 4))), "r", 1)
    rows = [(c, t, pick.choice(["user", "assistant", "<|end|>", "<"]), [part() for _ in range(pick.randint(0, 6))]) for c in range(150) for t in range(3)]
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    made = chat_format.format_chats(frame)
    shown = lambda k: chat_format.PLACEHOLDERS.get("document" if k is None else k, chat_format.OTHER_PLACEHOLDER)
    for row in chat_format.read_chats(made).collect():
        own = [r for r in rows if r[0] == row.conv_id]
        texts = ["".join(p[1] if p[0] == "text" else shown(p[0]) for p in r[3]) for r in own]
        assert [(t.role, t.text) for t in row.turns] == [(r[2], text) for r, text in zip(own, texts)]
        assert "".join(row.loss_texts) == "".join(text for r, text in zip(own, texts) if r[2] == "assistant")
        assert row.formatted.count("<|end|>") == row.formatted.count("<|body|>") == row.formatted.count("<|turn|>") == 3
    held = {r.conv_id: [a.kind for a in r.attachments] for r in made.collect()}
    assert all(held[c] == ["document" if p[0] is None else p[0] for r in rows if r[0] == c for p in r[3] if p[0] != "text"] for c in held)


def test_broken_texts_are_read(spark):
    mask = "array(named_struct('skip', 1, 'take', 1))"
    rows = spark.sql(f"SELECT * FROM VALUES (1, '', {mask}), (2, '<|end|>', {mask}), (3, '<|turn|>a<|end|><|turn|>b<|body|>c', {mask}) AS t(conv_id, formatted, loss_mask)")
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_chats(rows).collect()}
    assert found == {1: [], 2: [("", "")], 3: [("a", "")]}


def test_repeated_turns_stay(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")] * 3, "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.format_chats(frame.withColumn("parts", chat_format.text_part(F.col("text"))))
    assert made.first().n_turns == 3 and in_the_jvm(chat_format.read_chats(made))


def test_digests(spark):
    row = queries.op9_chat_format(spark, SMALL).where("conv_id = -7").first()
    text = queries.ODD_TEXT
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
