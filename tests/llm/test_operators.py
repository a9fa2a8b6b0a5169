"""Filters, scores, scans, mixing and neighbours against brute force, and their border cases."""

import base64
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from vigilake.llm import decontaminate, language, mixing, neighbours, queries, secrets, toxicity, url_filter


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- language

SENTENCES = {
    "en": "the weather is nice today and we should think about those things together",
    "de": "das wetter ist heute schön und wir möchten über diese dinge gemeinsam sprechen",
}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in entry.queries()["op6_language_id"](spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    tested = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tested) >= 0.9 * len(tested)


def test_language_border_cases(spark):
    schema = "id long, text string, lang string, lang_pred string"
    rows = [(i, f"{s} {i}", lang, "x") for lang, s in SENTENCES.items() for i in range(6)]
    rows += [(90, None, "en", None), (91, "", "en", None), (92, "12 :-)", "en", None), (None, "the nice weather", None, None)]
    docs = frame(spark, rows, schema)
    filters = language.fit(docs, "id", "text", "lang", allowed=F.lit(True), n_slots=1 << 12)
    assert filters.languages == ["de", "en"]
    out = {r["id"]: r for r in language.predict(docs.drop("lang_pred"), filters, F.col("text")).collect()}
    assert [out[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3
    assert out[None]["lang_pred"] == "en" and 0 <= out[None]["lang_score"] <= 1
    assert language.predict(docs.limit(0).drop("lang_pred"), filters, F.col("text")).count() == 0
    nothing = language.fit(docs, "id", "text", "lang", allowed=F.lit(False), n_slots=1 << 12)
    assert nothing.decide("any text") == ("und", 0.0)


def test_counts_correct_false_positives():
    letters = language.letter_table()
    rows = np.zeros((1 << 12, 1), dtype=np.uint64)
    known = language.gram_hashes("the weather is nice", letters)
    for probe in range(language.PROBES):
        rows[language.slots(known, len(rows), probe), 0] |= np.uint64(1)
    rng = np.random.default_rng(1)
    rows[rng.choice(len(rows), 2048, replace=False), 0] |= np.uint64(2)  # a language that is noise at half fill
    filters = language.Filters(["a", "b"], rows, letters)
    assert filters.decide("the weather is nice")[0] == "a"
    assert 0.2 < filters.false_rate[1] < 0.3


# ---- toxicity

def test_toxicity_of_held_out_documents(spark):
    rows = entry.queries()["op2_toxicity"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(4)
    words = ["calm", "river", "stone", "green", "walk", "light"]
    text = lambda bad: " ".join(rng.choice(words) for _ in range(20)) + (" you rotten grub" if bad else "")
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = frame(spark, [(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, text int")
    half = F.col("doc_id") < 120
    third = F.col("doc_id").between(120, 179)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, half, third, trees=5, depth=2).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 180)
    assert 0 <= got[900] <= 0.3 and got[900] == got[901]
    one = labels.where("toxic = 0")
    flat = toxicity.score_toxicity(docs, one, half, third).select("score").distinct().collect()
    assert len(flat) == 1 and 0 < flat[0][0] < 0.1
    assert toxicity.score_toxicity(docs.limit(0), labels, half, third).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0), half, third).count() == docs.count()


def test_obfuscated_words_are_read():
    assert toxicity.plain_spelling("gr.u8b".replace("8", "")) == "grub"
    assert toxicity.plain_spelling("r0tt3n") == "rotten"
    features = toxicity.text_features("you r0tt3n fellow", {"rotten"}, set())
    assert features[7] > 0 and len(features) == toxicity.N_FEATURES


# ---- secrets

def plain_spans(text):
    out = []
    pattern = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


SECRETS = "/root/testdata/sf0.01"  # the smallest tables hold none


def test_secret_query_matches_the_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SECRETS}/documents.parquet").collect()}
    rows = entry.queries()["op10_secret_scan"](spark, SECRETS).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]] or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{kind}"] for kind in ("assign", "access", "hex")] == [
            sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",") if r["spans"] else [])
    assert any(r["n_assign"] or r["n_access"] or r["n_hex"] for r in rows)


def der(tag, body):
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else b"\x82" + size.to_bytes(2, "big")) + body


def rsa_like_key():
    numbers = b"".join(der(2, bytes([1]) * n) for n in (129, 3, 128, 65, 65, 64, 64, 64))
    return der(0x30, der(2, b"\0") + numbers)


def test_base_spans_match_the_patterns():
    rng = random.Random(8)
    pieces = ["password", "PassWD=", "token : '", "secret=", "api_key:", "apikey = \"", "AKIA", "ABCDEF0123456789", "deadbeef00112233",
              "é", " ", "\n", "token=secret=abcdefghijkl", "xyz", "K", "ſecret=abcdefghijklmnop", "="]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        base = [s for s in secrets.find_spans(text) if s[0] in ("assign", "access", "hex")]
        assert base == plain_spans(text), text


def test_structure_is_confirmed():
    part = lambda value: base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.c2lnbmF0dXJlLi4u"
    fake = f"{part({'typ': 'JWT', 'x': 12})}.{part({'sub': 'someone'})}.c2lnbmF0dXJlLi4u"
    key = base64.b64encode(rsa_like_key()).decode()
    broken = base64.b64encode(rsa_like_key()[:-1]).decode()
    armoured = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    public = base64.b64encode(b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-rsa", b"\1\0\1", b"\7" * 129))).decode()
    kinds = lambda text: [s[0] for s in secrets.find_spans(text) if s[0] not in ("assign", "access", "hex")]
    assert kinds(f"see {token} here") == ["jwt"]
    assert kinds(f"see {fake} here") == []
    assert kinds(f"é {armoured}") == ["pem", "key"]
    assert kinds(f"key {broken} end") == []
    assert kinds(f"ssh-rsa {public} me") == ["key"]
    assert "key" in kinds(rsa_like_key().hex())
    start = secrets.find_spans(f"é {armoured}")[0][1]
    assert start == 2


def test_secret_query_border_cases(spark):
    docs = frame(spark, [(1, None), (1, None), (None, "token=abcdefghijkl")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    assert found[1] == [] and [s["kind"] for s in found[None]] == ["assign"]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


# ---- URLs

def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_url_query_matches_the_rules(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = entry.queries()["op4_url_filter"](spark, SMALL).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        host, path = plain_parts(urls[r["page_id"]])
        rule = plain_rule(host, path, queries.URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (queries.URL_RULES[rule] if rule else r["verdict"])
        assert r["verdict"] in ("allow", "block")


def test_url_rules_say_what_the_contract_says(spark):
    said = {"a.com/en/1": "block", "example.com/en/7x": "allow", "a.net/de/1": "allow", "example.net/de/80": "block",
            "net/de/": "allow", "b.example.net/de/8": "block", "example.net/de/7": "allow", "a.org/es/8": "block"}
    table = frame(spark, [(i, f"http://{u}") for i, u in enumerate(said)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(table, queries.URL_RULES).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_url_parts_and_templates(spark):
    odd = [None, "", "no scheme/path", "http://A.Com", "http://a.com?x=/en/", "x://É.com/en/#y", "a://b://c/d?e", "\nh://a.com/\n/en"]
    pages = [(i, u, "") for i, u in enumerate(odd)]
    # one section of a host is blocked by a rule for most numbers; the same template elsewhere follows its label
    pages += [(100 + i, f"http://n.example.com/spam/1{i}", "") for i in range(60)]
    pages += [(200 + i, f"http://n.example.com/spam/2{i}", "") for i in range(5)]
    pages += [(300 + i, f"http://n.example.com/good/1{i}", "") for i in range(60)]
    table = frame(spark, pages, "page_id long, url string, rule string")
    rules = {"n.example.com/spam/1": "block", "n.example.com/good/11": "allow"}
    got = {r["page_id"]: r for r in url_filter.filter_urls(table, rules).collect()}
    for i, u in enumerate(odd):
        assert (got[i]["host"], got[i]["path"]) == plain_parts(u)
    assert all(got[200 + i]["verdict"] == "block" and got[200 + i]["rule"] is None for i in range(5))
    assert all(got[300 + i]["verdict"] == "allow" for i in range(60))
    assert got[200]["template"] == "/spam/<#>"
    assert url_filter.filter_urls(table.limit(0), rules).count() == 0


# ---- decontamination

def test_contamination_word_borders(spark):
    # listed characters are one look-up in the pattern matcher; ranges and counting by pattern took most of the query's time
    assert re.fullmatch(r"\[(\\x[0-9A-F]{2})+\]\+", decontaminate.GAP)
    texts = [f"a{chr(c)}b" for c in [*range(0x180), 0x2028, 0x212A, 0x1F600]] + ["", " ", "\x00a", "é  b\x7f"]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    items = frame(spark, [(1, "a")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.find_contamination(docs, items).collect()}
    for i, t in enumerate(texts):
        plain = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
        assert got[i] == (len(plain), plain.count("a")), t


def test_contamination_border_cases(spark):
    long = "one two three four five six seven eight nine ten eleven"
    items = frame(spark, [(1, long, "x"), (2, "Tiny ITEM", "x"), (3, None, "x"), (4, "...", "x"), (10, long, "x"), (None, "lone", "x")],
                  "item_id long, text string, words string")
    docs = frame(spark, [
        (1, f"zero {long.upper()} twelve", 0), (2, "a tiny, item! and a tiny thing item", 0), (3, None, 0), (4, "", 0),
        (5, "one two three four five six seven eight nine", 0), (6, "lone é", 0), (6, "lone é", 0), (None, "tiny item", 0),
    ], "doc_id long, text string, windows int")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(docs, items).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 13, 11, ["1", "10"]), (2, 8, 2, ["2"]), (3, 0, 0, []), (4, 0, 0, []), (5, 9, 0, []),
        (6, 2, 1, []), (6, 2, 1, []), (None, 2, 2, ["2"]),
    ], key=str)
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, items.limit(0)).collect()} == {0}


# ---- mixing

def plain_targets(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 2 * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mixture_meets_its_targets(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = entry.queries()["op7_source_mixing"](spark, SMALL).collect()
    sizes = {}
    for r in docs.values():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    targets = plain_targets(sizes)
    taken, largest = {}, {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], targets[source], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
        largest[source] = max(largest.get(source, 0), r["size"])
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    again = entry.queries()["op7_source_mixing"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixture_border_cases(spark):
    rows = [(1, "a b c", None), (1, "a b c", None), (2, None, "s"), (3, "", "s"), (None, "x y", "b"), (5, "one", "b"), (6, "one", "c")]
    docs = frame(spark, [(*r, 1.0) for r in rows], "doc_id long, text string, source string, rate double")
    got = mixing.mix_sources(docs).collect()
    sizes = {None: 6, "s": 0, "b": 3, "c": 1}
    targets = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["target"], targets[r["source"]], abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# ---- neighbours

def test_neighbours_query_finds_the_nearest(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {}
    for r in entry.queries()["op1_nearest_neighbours"](spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries_ = [q for q in rows if q[0] % 100 == 0]
    assert set(got) == {q[0] for q in queries_}
    hits = 0
    for i, v in queries_:
        true = sorted((math.sqrt(((v - w) ** 2).sum()), j) for j, w in rows if j != i)
        near = sorted(got[i])
        assert [r for r, _, _ in near] == list(range(1, 11))
        assert [(s, j) for _, j, s in near] == sorted((s, j) for _, j, s in near)
        exact = dict((j, d) for d, j in true)
        assert all(math.isclose(exact[j], s, rel_tol=1e-12) for _, j, s in near)
        hits += len({j for _, j in true[:10]} & {j for _, j, _ in near})
    assert hits >= 0.9 * 10 * len(queries_)


@pytest.mark.parametrize("blocks", [20_000, 7])
def test_neighbours_in_larger_data(spark, blocks):
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.normal(size=(300, 8)), np.ones((60, 8))]) # with one very common vector
    rows = [(i, v.tolist(), "t") for i, v in enumerate(data)]
    rows += [(1000, None, "t"), (1001, [0.0] * 8, "t"), (1002, [float("nan")] * 8, "t"), (1003, [1.0, None] * 4, "t"),
             (1004, [1.0] * 3, "t"), (1005, [], "t"), (None, [1.0] * 8, "t"), (5, data[5].tolist(), "t")]
    table = frame(spark, rows, "vec_id long, embedding array<double>, tree string")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=5, trees=4, leaf_rows=40, block_rows=blocks, block_queries=blocks)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = 0
    for q in range(0, 360, 20):
        true = sorted((float(np.sqrt(((data[q] - w) ** 2).sum())), j) for j, w in enumerate(data) if j != q)[:5]
        assert len(got[q]) == 5
        hits += len({j for _, j in true} & {j for _, j in got[q]})
    assert set(got) == set(range(0, 360, 20))
    assert hits >= 0.9 * 5 * 18
    assert sorted(got[340]) == [(0.0, j) for j in range(300, 305)]


def test_neighbours_of_few_rows(spark):
    table = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(table, F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 1.0)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0
