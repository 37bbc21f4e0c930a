"""Edge cases and brute force for every operator."""

import array
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from support import DATA, same_as_sql

from trialweave.llm import fingerprints as fp
from trialweave.llm import langid, lm, neardup, packing
from trialweave.llm.common import words
from trialweave.llm.license_rules import rules
from trialweave.llm.licenses import license_scan
from trialweave.llm.linededup import line_dedup
from trialweave.llm.mixing import draws, mix, mix_report, shard_quotas
from trialweave.llm.quality import quality_filter, quality_rules
from trialweave.llm.queries import ORACLE_SQL, QUERIES
from trialweave.llm.urlfilter import intervals, url_filter, url_keys

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1


def brute_license(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    places = [(i, label) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for p in [phrase.split()] for i in range(len(found)) if found[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark, odd, none):
    extra = docs_of(spark, [(20, "MIT License mit-license GNU Lesser General Public License v2.1 ... Apache License", None, None), (21, "KK MİT license mit licence licensed", None, None), (22, "MIT LICENSE " * 3000, None, None)])
    for docs in (odd, extra):
        found = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan(docs).collect()]
        assert sorted(map(str, found)) == sorted(str((d, *brute_license(t))) for d, t in texts(docs))
    by_id = {r["doc_id"]: r for r in license_scan(extra).collect()}
    assert by_id[20]["labels"] == "apache,gpl,lgpl-2.1,mit"
    assert by_id[20]["n_suppressed"] > 0
    assert all(0 <= r["score"] <= 1 for r in by_id.values())
    assert license_scan(none).count() == 0


def test_license_rules_need_their_gate_words():
    """Each rule's pattern compiles, and each alternative of its gate is a word that it can match."""
    assert len(rules()) > 300
    for rule in rules():
        assert re.compile(rule.pattern)
        assert any(re.search(rf"(?<![a-z0-9]){g}", rule.pattern) for g in rule.gate.split("|")), rule


# 2


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark, odd, none):
    rows = mix_report(odd).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r, (d, t) in zip(sorted(rows, key=str), sorted(texts(odd), key=str), strict=False):
        assert r["taken"] <= 2 * r["size"]
    full = odd.select("doc_id", "text", "source").collect()
    for r in full:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = brute_targets(dict(sizes))
    found = draws(odd).collect()
    for r in found:
        taken[r["source"]] += sum(x["words"] for x in r["draws"])
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert taken[s] == math.floor(t + 1e-9)
    assert len(rows) == len(full)
    assert sorted(map(str, rows)) == sorted(map(str, mix_report(odd.repartition(5)).collect()))
    mixed = mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len(WORD.findall(t)) for _, t in texts(mixed)) == sum(r["taken"] for r in rows)
    assert mix_report(none).count() == 0
    assert mix(none).count() == 0


def test_repeated_rows_meet_the_target_and_shards_are_apart(spark):
    rows = [(1, "a b c d e f g h i j " * 50, "en", "s")] * 6 + [(None, f"w{i} " * 100, "en", "t") for i in range(30)] + [(k, "x y z " * 40, "de", "u") for k in range(40)]
    docs = docs_of(spark, rows).repartition(3)
    found = draws(docs, shards=4)
    want = collections.Counter((x["shard"], r["doc_id"], x["words"]) for r in found.collect() for x in r["draws"])
    sizes, got = collections.Counter(), collections.Counter()
    mixed = mix(docs, shards=4).rdd.glom().collect()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    for row in (r for part in mixed for r in part):
        got[row["source"]] += len(row["text"].split())
    assert got == {s: math.floor(t + 1e-9) for s, t in brute_targets(dict(sizes)).items()}
    held = [collections.Counter((r["doc_id"], len(r["text"].split())) for r in part) for part in mixed if part]
    for shard in {k[0] for k in want}:  # each shard is a partition
        assert collections.Counter({k[1:]: n for k, n in want.items() if k[0] == shard}) in held


def brute_split(blocks, shards, seed=17):
    """The tree, block by block: {(rank, shard): blocks}."""
    nodes = {1: blocks}
    for _ in range(shards.bit_length() - 1):
        below = {}
        for node, counts in nodes.items():
            each = sorted((int(hashlib.md5(f"{seed}:{node}:{rank}:{k}".encode()).hexdigest()[:15], 16), rank, k) for rank, n in counts.items() for k in range(1, n + 1))
            for side, part in enumerate((each[: len(each) // 2], each[len(each) // 2 :])):
                below[2 * node + side] = collections.Counter(rank for _, rank, _ in part)
        nodes = below
    return {(rank, node - shards): n for node, counts in nodes.items() for rank, n in counts.items()}


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(0, 4000), (1, 1500), (2, 0), (3, 7)], "rank int, quota long")
    found = shard_quotas(quotas, 8, 10).collect()
    total, by_shard = collections.Counter(), collections.Counter()
    for r in found:
        total[r["rank"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert total == {0: 400, 1: 150, 3: 1}
    assert {(r["rank"], r["shard"]): r["blocks"] for r in found} == brute_split({0: 400, 1: 150, 2: 0, 3: 1}, 8)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert len({r["blocks"] for r in found if r["rank"] == 0}) > 1  # drawn, not dealt evenly


# 3


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(fold(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_near_duplicates(spark, odd, none):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = random.choices(vocabulary, k=60)
    rows, base = [], random.choices(vocabulary, k=120)
    for i in range(60):  # copies that are near the first text, but often not near each other
        copy = list(base)
        for _ in range(random.randint(0, 5)):
            copy[random.randrange(120)] = f"x{random.random()}"
        rows.append((100 + i, " ".join(copy)))
    for i in range(40):  # texts of which a passage is most
        rows.append((200 + i, " ".join(passage + random.choices(vocabulary, k=random.randint(8, 30)))))
    rows += [(300 + i, " ".join(random.choices(vocabulary, k=random.randint(1, 8)))) for i in range(40)]
    rows += [(400 + i, "tiny text") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert found == brute_components(rows)
    once = [(d, t) for d, t in dict(texts(odd.where("doc_id is not null"))).items()]
    found = neardup.near_duplicates(odd).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None} == brute_components(once)
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(str(d) for d, _ in texts(kept)) == sorted([str(d) for d, x in brute_components(once).items() if x[2]] + ["None", "None"])
    assert neardup.near_duplicates(none).count() == 0


def test_links_of_any_text_of_a_repeated_id(spark):
    words = [f"w{i}" for i in range(300)]
    a, b = words[:100], words[100:220]
    text = lambda ws, k: " ".join([*ws[:-k], *(f"x{i}" for i in range(k))]) if k else " ".join(ws)
    rows = [(1, text(a, 0)), (1, text(b, 0)), (2, text(a, 3)), (3, text(b, 0)), (4, text(b, 4)), (5, None), (5, "alone here"), (6, "alone here"), (7, ""), (3, None), (None, text(a, 0))]
    found = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert found == sorted([("1", 96, 1, True), ("1", 116, 1, True), ("2", 96, 1, False), ("3", 116, 1, False), ("3", 0, 1, False), ("4", 116, 1, False), ("5", 0, 5, True), ("5", 1, 5, True), ("6", 1, 5, False), ("7", 0, 7, True), ("None", 96, None, True)])


def test_one_bucket_and_one_shingle_that_hold_most_rows(spark):
    """Copies, near copies and a passage that most texts share; results are those of brute force."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    body, passage = rng.choices(vocabulary, k=80), rng.choices(vocabulary, k=30)
    near = lambda: [w if rng.random() > 0.004 else f"y{rng.random()}" for w in body]
    rows = [(i, " ".join(body)) for i in range(150)] + [(200 + i, " ".join(near())) for i in range(150)] + [(400 + i, " ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_band_keys_agree_as_often_as_sets():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400):
        shared = 0
        for _ in range(200):
            a = rng.integers(0, 2**63, 4 * n).astype(np.uint64)
            x, y = np.unique(a[: 3 * n]), np.unique(a[n:])
            shared += (neardup.band_keys(x) == neardup.band_keys(y)).mean() / 200
        assert abs(shared - 0.5**4) < 0.03


# 4


def brute_bins(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fit = [x for x in bins if x >= length]
        if fit:
            bins.remove(min(fit))
        bins.append((min(fit) if fit else capacity) - length)
    return len(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    random.seed(seed)
    capacity = random.choice([1, 5, 10, 37, 64])
    counts = collections.Counter(random.randint(1, capacity) for _ in range(random.randint(0, 200)))
    rows, used = packing.plan(counts, capacity), collections.defaultdict(list)
    for length, n in counts.items():
        own = sorted(r for r in rows if r[0] == length)
        for rank in range(n):
            _, first, each, sequence, offset = [r for r in own if r[1] <= rank][-1]
            used[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == brute_bins(counts.elements(), capacity)


def test_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, quick = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x <|endoftext|>  y"):
        assert quick.encode(text) == array.array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    random.seed(5)
    letters = " \t\n  abcABC.,'’éñß<|endoftext|>  0123１２　\xa0日本🙂s'tllve\x85\x1c-_"
    for k in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        text += "<|endoftext|>" * (k % 7 == 0) + text[::-1] * (k % 2)
        assert quick.encode(text) == array.array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(30, "first page <|endoftext|> second page")], "doc_id long, text string"))
    rows = packing.pack(odd).collect()
    want = collections.Counter()
    for d, t in texts(odd):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : start + (first if k == 0 else 1024)]
            want[(d, k, start, len(part), zlib.crc32(array.array("I", part).tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) == brute_bins([r["length"] for r in rows], 1024)
    assert packing.pack(none).count() == 0


# 5


def test_url_filter(spark):
    moment = lambda day: f"2024-01-{day:02d} 00:00:00"
    captures = [
        (1, "http://Sub.Example.org:80/a/b?x#y", moment(5)), (2, "http://example.org/", moment(1)), (3, "http://example.org/", moment(10)), (4, "http://other.net", moment(5)), (5, None, moment(5)),
        (6, "not a url", moment(5)), (7, "http://example.org/ok/page", moment(5)), (8, "http://example.org", None), (9, "http://notexample.org/", moment(5)), (1, "http://Sub.Example.org:80/a/b?x#y", moment(5)), (None, "https://u:p@example.org./", moment(5)),
    ]
    entries = [("l", "block", "example.org", "add", moment(2)), ("l", "block", "example.org", "add", moment(4)), ("l", "block", "example.org", "remove", moment(9)), ("l", "block", "example.org", "add", moment(20)), ("w", "allow", "example.org/ok/", "add", moment(3)), ("w", "block", None, "add", moment(1)), ("w", "block", "x", "remove", moment(1))]
    pages = spark.createDataFrame([(*c, 0) for c in captures], "page_id long, url string, fetched_at string, verdict int").withColumn("fetched_at", __import__("pyspark").sql.functions.to_timestamp("fetched_at"))
    listed = spark.createDataFrame(entries, "list string, action string, key string, op string, dated string").withColumn("dated", __import__("pyspark").sql.functions.to_timestamp("dated"))
    found = collections.Counter((r["page_id"], r["verdict"], r["key"]) for r in url_filter(pages, listed).collect())
    assert found == collections.Counter({(1, "block", "example.org"): 2, (2, "keep", None): 1, (3, "keep", None): 1, (4, "keep", None): 1, (5, "invalid", None): 1, (6, "invalid", None): 1, (7, "allow", "example.org/ok/"): 1, (8, "keep", None): 1, (9, "keep", None): 1, (None, "block", "example.org"): 1})
    assert intervals(listed).count() == 3
    assert url_filter(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter(pages, listed.limit(0)).collect()} == {"keep", "invalid"}
    keys = spark.range(1).select(url_keys(__import__("pyspark").sql.functions.lit("http://a.b.c/x/y?q"))).first()[0]
    assert keys == ["a.b.c", "b.c", "c", "a.b.c/", "a.b.c/x/", "a.b.c/x/y"]


def test_url_filter_hot_host_long_urls_and_clashing_columns(spark, monkeypatch):
    """One host and month with most captures gives what each capture gives alone; brute force by its own keys."""
    from trialweave.llm import urlfilter

    hosts = ["big.example.com"] * 300 + [f"h{i}.example.net" for i in range(40)] + ["[2001:db8::1]:8080", "com", "example.com"]
    rows = [(i, f"https://{h}/{'p' * (20000 if i == 5 else i % 3)}/x", f"2024-03-{1 + i % 28:02d} 00:00:00", *range(5)) for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched_at string, key int, month int, salt int, list int, hot int").withColumn("fetched_at", __import__("pyspark").sql.functions.to_timestamp("fetched_at"))
    entries = [("l", "block", "example.com", "add", "2024-03-05"), ("l", "allow", "big.example.com/p/", "add", "2024-03-10"), ("l", "block", "com", "add", "2024-03-20"), ("l", "block", "[2001:db8::1]", "add", "2024-01-01"), ("l", "block", "example.com", "remove", "2024-03-15")]
    listed = spark.createDataFrame(entries, "list string, action string, key string, op string, dated string").withColumn("dated", __import__("pyspark").sql.functions.to_timestamp("dated"))

    def brute(url, day):
        host = re.match(r"https://(\[.*?\]|[^/:]+)", url)[1]
        path = url.split("/", 3)[3].split("/")
        keys = [*(".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)), f"{host}/", f"{host}/{path[0]}/", f"{host}/{path[0]}/x"]
        open_ = [(len(k), a == "allow", a) for _, a, k, op, since in entries if op == "add" and k in keys and since <= day and not (k == "example.com" and day >= "2024-03-15")]
        return max(open_)[2] if open_ else "keep"

    want = {r[0]: brute(r[1], r[2][:10]) for r in rows}
    for limit in (1_000_000, 2):  # with listed keys broadcast, or too many for that
        monkeypatch.setattr(urlfilter, "LISTED", limit)
        assert {r["page_id"]: r["verdict"] for r in url_filter(pages, listed).collect()} == want
    assert {"block", "allow", "keep"} == set(want.values())


# 6


def test_line_dedup(spark, odd, none):
    found = line_dedup(odd)
    assert [c for c in found.columns if c in odd.columns] == [c for c in odd.columns if c != "n_lines"] + ["n_lines"]
    rows = {r["doc_id"]: r for r in found.where("doc_id is not null").collect()}
    was = dict(texts(odd.where("doc_id is not null")))
    assert found.count() == odd.count()
    assert rows[-5]["text"] == was[-5]  # the first by id keeps all
    assert rows[3]["text"] == ""
    assert rows[3]["n_removed_lines"] == 12
    assert rows[2]["n_removed_lines"] >= 10  # its last line stands elsewhere before another one
    assert rows[1]["n_removed_lines"] >= 6
    assert rows[1]["text"].endswith("its own")
    assert rows[4]["text"] is None
    for d in (5, 6, 7, 8, 9, 10):
        assert rows[d]["text"] == was[d]
    assert line_dedup(none).count() == 0


def test_chunks_resynchronise(spark):
    lines = [f"some line number {i} of the shared part" for i in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["mine 1", "mine 2", *lines, "mine 3"])), (3, "\n".join([*lines[:30], "a new line in the middle", *lines[30:]]))]
    found = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed_lines"] == 0
    assert found[2]["n_removed_lines"] >= 48
    assert found[3]["n_removed_lines"] >= 48


# 7


def test_language_id(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    rows = langid.language_id(odd).collect()
    assert len(rows) == odd.count()
    langs = {r["lang"] for r in odd.select("lang").collect()} - {None}
    for r, (_, t) in zip(sorted(rows, key=lambda r: str(r["doc_id"])), sorted(texts(odd), key=lambda x: str(x[0])), strict=True):
        assert r["lang_pred"] in langs | {"und"}
        if r["doc_id"] in (4, 5, 6, 10):
            assert r["lang_pred"] == "und"
    assert langid.language_id(none).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(odd, {}).collect()} == {"und"}


def test_language_id_like_brute_force(spark):
    """Sample, dictionaries and every prediction, done again without Spark's part in it."""
    import zstandard

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    digests = {r["doc_id"]: (r["a"], r["b"]) for r in docs.selectExpr("doc_id", "xxhash64(5, doc_id) as a", "xxhash64(7, doc_id) as b").collect()}
    rows, chosen = docs.select("doc_id", "text", "lang").collect(), collections.defaultdict(list)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    clean = lambda t: " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())).encode()
    for d, t, lang in rows:
        if lang is not None and clean(t) and not held(d):
            at = digests[d][1] % max(len(t) - langid.CHARS + 1, 1)
            chosen[lang].append((digests[d][0], t[at : at + langid.CHARS]))
    tools = {}
    for lang, found in chosen.items():
        passages, room, parts = sorted((clean(t) for _, t in sorted(found)[: langid.DOCS]), key=lambda p: (len(p), p)), langid.DICTIONARY, []
        passages = [p for p in passages if p]
        for k, text in enumerate(passages):
            parts.append(text[: max(0, room // (len(passages) - k) - 1)])
            room -= len(parts[-1]) + 1
        assert len(b" ".join(parts)) <= langid.DICTIONARY
        kind = zstandard.ZstdCompressionDict(b" ".join(parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kind.precompute_compress(level=langid.LEVEL)
        tools[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=kind, write_checksum=False, write_content_size=False, write_dict_id=False)

    def predict(text):
        data = clean(text)
        sizes = sorted((sum(len(tool.compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)), lang) for lang, tool in tools.items())
        return (sizes[0][1], round((sizes[1][0] - sizes[0][0]) / sizes[1][0], 9)) if data else ("und", 0.0)

    found = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9), r["accepted"]) for r in langid.language_id(docs).collect()}
    want = {d: (held(d), *predict(t)) for d, t, _ in rows}
    assert found == {d: (*x, x[2] >= langid.MARGIN) for d, x in want.items()}


def test_language_sample_is_bounded_and_even(spark):
    rows = [(7, "the same id again and again " * 9, "en", "s")] * 500 + [(8, "ein kurzer text", "de", "s")]
    learnt = langid.learn(docs_of(spark, rows))
    assert 0 < len(learnt["en"]) <= langid.DICTIONARY
    assert learnt["de"] == b"ein kurzer text"
    even = langid.filled([bytes([65 + i]) * 400 for i in range(64)])
    assert {even.count(bytes([65 + i])) for i in range(60)} <= {254, 255, 256}
    assert len(even) <= langid.DICTIONARY


# 8


@pytest.mark.parametrize("c", [2, 7, 40])
@pytest.mark.parametrize("x", [0.05, 1.0, 30.0])
def test_tables_are_drawn_from_their_exact_distribution(c, x):
    """By weights and by the sampler for many customers alike."""
    d, n = 0.6, 20000
    stirling = lm.log_stirling(d)
    weight = np.array([stirling[c, t] + t * math.log(x) for t in range(1, c + 1)])
    weight = np.exp(weight - weight.max())
    rng = np.random.default_rng(0)
    for drawn in (lm.draw_tables(np.full(n, c), np.full(n, x), d, rng), lm._tables_of_many(np.full(n, c), np.full(n, x), d, rng)):
        assert drawn.mean() == pytest.approx((weight / weight.sum()) @ np.arange(1, c + 1), rel=0.05)
    np.testing.assert_allclose(np.bincount(lm.draw_tables(np.full(n, c), np.full(n, x), d, rng), minlength=c + 1)[1:] / n, weight / weight.sum(), atol=0.015)


def test_tables_of_very_many_customers():
    """With few customers at other tables, one table has nearly all and the others are a Poisson number of mean x / d."""
    drawn = lm.draw_tables(np.full(4000, 10**7), np.full(4000, 1.2), 0.6, np.random.default_rng(1))
    assert drawn.mean() - 1 == pytest.approx(2.0, rel=0.06)
    assert (lm.draw_tables(np.array([0, 1]), np.ones(2), 0.5, np.random.default_rng(1)) == [0, 1]).all()


def small_bucket(contexts, d=(0.6, 0.7)):
    """A bucket of {(before, v): {word: count}}; before 0 means that the word's own restaurant is the context."""
    rows = sorted((v, before, w, c) for (before, v), words in contexts.items() for w, c in words.items())
    v, before, w, c = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return lm.Bucket([[v, np.zeros_like(v), before, w, c]], d), rows


def test_probabilities_sum_to_one_in_every_context():
    """Over all known words and the unknown one, for pair, word and first-token contexts, seen in training or not, in every state."""
    known = 12
    rng = np.random.default_rng(3)
    every = {w: 0 for w in range(known + 1)}  # word 12 is unknown
    seen = lambda: every | {int(w): int(c) for w, c in zip(rng.integers(0, known, 6), rng.integers(1, 200, 6), strict=True)}
    contexts = {(0, 1): seen(), (0, 2): seen(), (0, 3): every, (5, 4): seen(), (6, 4): seen(), (7, 4): every, (5, 8): every, (0, 0): seen()}
    bucket, rows = small_bucket(contexts)
    model = {"uniform": 1 / (known + 1), "root_d": 0.5}
    for _ in range(4):
        customers = bucket.for_root()
        customers[:known] += 1  # each known word has a customer
        tables = lm.draw_tables(customers, np.full(len(customers), 0.8), 0.5, rng)
        p = lm.root_p(customers, tables, model | {"root_customers": customers.sum(), "root_tables": tables.sum()})
        assert p.sum() == pytest.approx(1, abs=1e-9)
        bucket.sweep(p, rng)
        sums = collections.Counter()
        for (v, before, _, _), x in zip(rows, bucket.predictive(p), strict=True):
            sums[(before, v)] += x
        assert len(sums) == len(contexts)
        assert all(abs(x - 1) < 1e-9 for x in sums.values())


def test_seating_settles_where_enumeration_says():
    """One word restaurant over a fixed root: the mean predictive probabilities over many sweeps are those of all seatings by their exact weights."""
    c, p, d = [5, 2, 1, 0], np.array([0.1, 0.2, 0.3, 0.4]), 0.7
    bucket, _ = small_bucket({(0, 1): dict(enumerate(c))}, (0.5, d))
    stirling, rng = lm.log_stirling(d), np.random.default_rng(5)
    exact, total = np.zeros(4), 0.0
    for a in range(1, 6):
        for b in (1, 2):
            t = np.array([a, b, 1, 0])
            weight = math.exp(sum(stirling[n, k] for n, k in zip(c, t, strict=True)) + sum(math.log(lm.THETA + d * i) for i in range(t.sum()))) * np.prod(p**t)
            total += weight
            exact += weight * (np.maximum(np.array(c) - d * t, 0) + (lm.THETA + d * t.sum()) * p) / (lm.THETA + sum(c))
    mean, n = np.zeros(4), 4000
    for _ in range(n):
        bucket.sweep(p, rng)
        mean += bucket.predictive(p) / n
    np.testing.assert_allclose(mean, exact / total, rtol=0.02)


class Counting:
    """A generator that counts the gamma variables and uniform numbers drawn from it."""

    def __init__(self):
        self.rng, self.drawn = np.random.default_rng(6), 0

    def __getattr__(self, name):
        return getattr(self.rng, name)

    def standard_gamma(self, shape):
        self.drawn += len(shape)
        return self.rng.standard_gamma(shape)

    def random(self, n):
        self.drawn += n
        return self.rng.random(n)


def test_restaurants_whose_tables_are_certain_cost_no_draws():
    """Most pairs occur once: dishes with one customer or none have as many tables, in every sweep."""
    certain = {(1 + k, 1 + k % 7): {k: 1, k + 1: 0} for k in range(200)}
    bucket, _ = small_bucket(certain | {(500, 9): {3: 2, 4: 1, 5: 6}, (0, 9): {3: 1}})
    p, rng = np.full(len(bucket.words), 1 / len(bucket.words)), Counting()
    for _ in range(3):
        bucket.pairs.sweep(bucket.pair_c, bucket.singles.predictive(bucket.customers(), p[bucket.dish_word])[bucket.open_dish], rng, bucket.open)
        assert (bucket.pairs.tables[bucket.pair_c < 2] == bucket.pair_c[bucket.pair_c < 2]).all()
    assert rng.drawn == 3 * (1 + 2)
    n = len(bucket.dish_word)
    assert (bucket.customers() == np.bincount(bucket.dish_of[bucket.pair], bucket.pairs.tables, n) + np.bincount(bucket.dish_of[bucket.single], bucket.c[bucket.single], n)).all()


@pytest.mark.parametrize("most", [3, 10**6, 2**62])
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_numbers_sorted_with_their_places(n, most):
    rng = np.random.default_rng(n)
    for values in (rng.integers(0, most, n), rng.integers(-most, most, n), np.repeat(rng.integers(0, most, n), 3)):
        order, found, new = lm._sorted(values)
        assert np.array_equal(order, np.argsort(values, kind="stable"))
        assert np.array_equal(found, values[order])
        want = np.unique(values, return_inverse=True)
        assert np.array_equal(found[new], want[0])
        for placed in (lm._placed(values), lm._ranked_runs(values)):
            assert all(map(np.array_equal, placed, want))


def test_stirling_numbers():
    """S(3, t) for discount d: (1-d)(2-d), 3(1-d), 1."""
    np.testing.assert_allclose(np.exp(lm.log_stirling(0.3)[3, 1:4]), [0.7 * 1.7, 3 * 0.7, 1.0])


def test_lm_scores(spark, odd, none):
    rows = lm.lm_scores(odd).collect()
    tokens = [(d, [*WORD.findall(fold(t)), None]) for d, t in texts(odd)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for d, ws in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)
    assert lm.lm_scores(none).count() == 0
    held_out = next(i for i in range(100) if held(i))
    (only,) = lm.lm_scores(docs_of(spark, [(held_out, "never learnt", None, None)])).collect()
    assert (only["train_tokens"], only["n_known"], only["score"]) == (0, 0, 0.0)


def test_lm_beats_the_base_on_held_out_text(spark):
    rows = [r for r in lm.lm_scores(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.85 * sum(r["base_score"] for r in rows)


def test_repeated_texts_are_likelier(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    once = [(i, " ".join(rng.choices(words, k=80)), None, None) for i in range(0, 120)]
    twice = [(200 + i + 100 * k, t, None, None) for i, t in enumerate(" ".join(rng.choices(words, k=80)) for _ in range(20)) for k in range(2)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    rows = {r["doc_id"]: r["perplexity"] for r in lm.lm_scores(docs_of(spark, [r for r in once + twice if not held(r[0])])).collect()}
    both = [p for d, p in rows.items() if d >= 200 and not held(200 + (d - 200) % 100) and not held(300 + (d - 200) % 100)]
    assert max(both) < min(p for d, p in rows.items() if d < 200)


def test_packed_arrays_round_trip():
    arrays = [np.arange(5, dtype=np.uint64) * 10**15, np.array([], np.uint16), np.array([True, False]), np.array([1.5, -2], np.float32)]
    for a, b in zip(arrays, lm._unpacked(lm._packed(*arrays)), strict=True):
        assert len(a) == len(b)
        assert (a == b).all()


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_lm_types_unpack_as_they_were(n):
    rng = np.random.default_rng(n)
    rows = np.unique(np.stack([rng.integers(0, 40, n) * lm.PARTS + rng.integers(0, 3, n), rng.integers(0, 9, n), rng.integers(0, 500, n)], axis=1), axis=0)
    c = rng.integers(0, 5, len(rows))
    found = lm._types(lm._nested(*rows.T, c))
    for a, b in zip(found, (rows[:, 0] // lm.PARTS, rows[:, 0] % lm.PARTS, rows[:, 1], rows[:, 2], c), strict=True):
        assert np.array_equal(a, b)


def test_lm_types_of_contexts_far_apart_are_whole_numbers():
    """Of two chunks, one with differences beyond 32 bits: together they must not turn into floats."""
    near, far = (np.array(x) * lm.PARTS for x in ([1, 2], [3, 900_000]))
    parts = [lm._types(lm._nested(x, np.array([0, 4]), np.array([5, 6]), np.array([1, 2]))) for x in (near, far)]
    assert {x.dtype for part in parts for x in part} == {np.dtype(np.int64)}
    assert np.concatenate([p[0] for p in parts]).tolist() == [1, 2, 3, 900_000]
    assert len(lm.Bucket(parts).c) == 4


# 9


def brute_edited(docs):
    """(doc_id, text, edited text, next text) of every row."""
    rows = [(r["doc_id"], r["text"] or "", r["h"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()]
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    out = []
    for i, (d, own, _) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        cut = len(own) // 3
        out.append((d, own, own[: len(own) - cut] + other[:cut], other))
    return out


def brute_likeness(a, b):
    """The share of bins in which the least span hashes agree, by Python's own numbers."""
    if a == b:
        return 1.0

    def sketch(text):
        points, width, least = [ord(c) + 1 for c in text], min(fp.SPAN, len(text)), {}
        for i in range(len(points) - width + 1 if points else 0):
            h = sum(x * pow(fp.BASES[0], -k, fp.MODULUS) for k, x in enumerate(points[i : i + width])) % fp.MODULUS
            h = h * 0x9E3779B97F4A7C15 % 2**64
            h = (h ^ (h >> 32)) * 0xBF58476D1CE4E5B9 % 2**64
            h ^= h >> 29
            least[h >> 58] = min(h, least.get(h >> 58, h))
        return {k: (h >> 20) % 0xFFFF for k, h in least.items()}

    x, y = sketch(a), sketch(b)
    held = set(x) | set(y)
    return sum(x.get(k) == y.get(k) for k in held) / len(held) if held else 0.0


def test_fingerprints(spark, odd, none):
    want = brute_edited(odd)
    shown = lambda d, n, sha, *near: (d, n, sha, *(round(x, 9) for x in near))
    brute = collections.Counter(shown(d, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_likeness(t, e), brute_likeness(t, o)) for d, t, e, o in want)
    for run in (8000, 3, 1):
        rows = fp.fingerprints(odd, run).collect()
        assert collections.Counter(shown(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows) == brute
    prints = collections.defaultdict(set)
    for r in rows:
        prints[r["n_chars"], r["fingerprint"]].add(r["doc_id"])
    assert len({f for _, f in prints}) == len({t for _, t, *_ in want})  # one for each text
    assert fp.fingerprints(none).count() == 0
    assert fp.fingerprints(odd.where("doc_id = 7")).first()["near_next"] == 1.0


@pytest.mark.parametrize("ids", [[None] * 60, [5] * 60, [None] * 20 + [5] * 20 + list(range(20)), [2**40 * i for i in range(40)] + list(range(20)), [-3, -2, -1]])
def test_runs_of_nulls_and_repeated_and_uneven_ids(spark, ids):
    docs = spark.createDataFrame([(d, f"text {i % 50} " * (i % 7)) for i, d in enumerate(ids)], "doc_id long, text string").repartition(3)
    found = fp.fingerprints(docs, 4)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found.collect()) == collections.Counter((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in brute_edited(docs))
    if len(ids) > 3:
        assert max(collections.Counter(r[0] for r in found.selectExpr("spark_partition_id()").collect()).values()) < len(ids) / 2


def test_likeness_follows_the_share_of_equal_spans():
    """Against the sets of spans themselves."""
    rng, powers = random.Random(3), fp.Powers()
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        near, true = [], []
        for _ in range(60):
            a = "".join(rng.choices("abcdefgh ", k=600))
            b = a[: int(600 * share)] + "".join(rng.choices("abcdefgh ", k=600 - int(600 * share)))
            spans = [{x[i : i + fp.SPAN] for i in range(600 - fp.SPAN + 1)} for x in (a, b)]
            true.append(len(spans[0] & spans[1]) / len(spans[0] | spans[1]))
            near.append(fp.likeness(*(fp.Prefixes(x, powers).fingerprint() for x in (a, b))))
        assert np.mean(near) == pytest.approx(np.mean(true), abs=0.03)


def test_spans_and_common_extensions():
    powers, rng = fp.Powers(), random.Random(2)
    for _ in range(50):
        a, b = ("".join(rng.choices("ab🙂", k=rng.randint(1, 60))) for _ in range(2))
        x, y = fp.Prefixes(a, powers), fp.Prefixes(b, powers)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        want = next((k for k in range(60) if a[i + k : i + k + 1] != b[j + k : j + k + 1] or i + k >= len(a)), 60)
        assert x.common(i, y, j) == want
        assert [x.span(k, 1)[0] for k in range(len(a))] == x.spans(1).tolist()


# 10


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def test_quality(spark, odd, none):
    extra = docs_of(spark, [(50, "a b c a b c d", "x", "y"), (51, "same line\nsame line\n\n \nsame  line", "x", "y"), (52, "# * $ ok & | <x>", "x", "y"), (53, "one two three four five " * 11, "x", "y"), (54, " ".join(f"w{i}" for i in range(50)), "x", "y")])
    for docs in (odd, extra):
        found = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules(docs).collect()]
        assert sorted(map(str, found)) == sorted(str((d, *brute_counts(t))) for d, t in texts(docs))
    kept = quality_filter(odd)
    assert kept.columns == odd.columns
    assert sorted(d for d, _ in texts(kept)) == sorted(d for d, t in texts(odd) if not brute_counts(t)[-1])
    assert quality_rules(none).count() == 0
    assert quality_filter(none).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(int(math.exp(rng.gauss(5.5, 0.7))) + 60)), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(300)), "en", "s") for i in range(12)]
    found = {r["doc_id"]: r["kept"] for r in quality_rules(docs_of(spark, clean + junk)).collect()}
    assert not any(found[i] for i, *_ in junk)
    assert sum(not found[i] for i, *_ in clean) <= 1


def brute_mcd(x):
    """Mean, factor and log determinant of the least of three starts, with numpy; shares go by cells as in the operator."""
    from trialweave.llm import quality as q

    floors = np.array(q.FLOORS)

    def cut(values, share):
        values = np.sort(values)
        return values[math.ceil(share * len(values) - 1e-9) - 1]

    def estimate(rows):
        m, cov = rows.mean(axis=0), (rows.T @ rows) / len(rows)
        cov = q.CONSISTENCY * (cov - np.outer(m, m)) + np.diag(floors**2)
        factor = np.linalg.cholesky(cov)
        return m, factor, 2 * np.log(np.diag(factor)).sum()

    def step(now):
        d2 = (np.linalg.solve(now[1], (x - now[0]).T) ** 2).sum(axis=0)
        cells = np.floor(np.log2(d2 + 2.0**-40) / q.DISTANCE_CELL)
        return estimate(x[cells <= cut(cells, q.SUPPORT)])

    cells = np.floor(x / q.PART_CELL)
    low, middle, high = (np.array([cut(c, share) for c in cells.T]) for share in (0.25, 0.5, 0.75))
    m, s = (middle + 0.5) * q.PART_CELL, np.sqrt(((high - low) * q.PART_CELL / 1.349) ** 2 + floors**2)
    starts = [(m, np.diag(s), 2 * np.log(s).sum()), estimate(x), estimate(m + s * np.tanh((x - m) / s))]
    for _ in range(q.FIRST):
        starts = [step(now) for now in starts]
    now = min(starts, key=lambda e: e[2])
    for _ in range(q.FIRST, q.MOST):
        was, now = now, step(now)
        if now[2] >= was[2] - q.SETTLED:
            return was if now[2] > was[2] + q.SETTLED else now
    return now


def test_distances_like_brute_force(spark):
    """Distance and verdict of every document, in one language and source and in a small group that uses all documents' estimate."""
    from trialweave.llm import quality as q

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    text = lambda n, mark: " ".join(word() + mark * (rng.random() < 0.3) for _ in range(n)) + "\nthe same line\n" * rng.randint(0, 2)
    rows = [(i, text(int(math.exp(rng.gauss(5.2, 0.6))) + 50, ""), "en", "s") for i in range(150)] + [(500 + i, text(120, "#"), "en", "s") for i in range(25)]
    rows += [(900 + i, text(90 + 10 * i, ""), "de", None) for i in range(8)]
    got = {r["doc_id"]: r for r in quality_rules(docs_of(spark, rows), least_group=60).collect()}
    fit = [r for r in got.values() if not r["base_failed"]]

    def vector(r):
        n, share = max(r["n_words"], 1), r["n_repeat_words"] / max(r["n_words"], 1)
        return [math.log1p(r["n_words"]), math.log(max(r["word_chars"], 1) / n), math.log1p(20 * r["n_symbols"] / n), math.log1p(5 * r["n_dup_lines"] / max(r["n_lines"], 1)), math.log((share + 0.05) / (1.05 - share))]

    own = brute_mcd(np.array([vector(r) for r in fit if r["lang"] == "en"]))
    every = brute_mcd(np.array([vector(r) for r in fit]))
    assert len(fit) > 150
    for r in got.values():
        m, factor, _ = own if r["lang"] == "en" else every
        d2 = (np.linalg.solve(factor, np.array(vector(r)) - m) ** 2).sum()
        assert r["distance"] == pytest.approx(d2, rel=1e-6)
        assert r["kept"] == (not r["base_failed"] and d2 <= q.LIMIT)


def test_words(spark):
    docs = spark.createDataFrame([(None,), ("",), (" a\tb \n",), ("x\xa0y",)], "text string")
    assert [r[0] for r in docs.select(words(docs["text"])).collect()] == [[], [], ["a", "b"], ["x\xa0y"]]


def brute_dedup(rows):
    """Line dedup document by document: {doc_id: lines that stay}."""
    from trialweave.llm.linededup import BASES, EVERY, LONGEST, MODULUS

    units = []
    for d, t in rows:
        lines = (t or "").split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        found = set()
        for base in BASES:
            marks = [((hashes[i - 1] if i else 0) * base + hashes[i]) % MODULUS % EVERY == 0 for i in range(len(lines))]
            starts = [0] + [i for i in range(1, len(lines)) if marks[i - 1] and not (i > 1 and marks[i - 2]) and not (base == BASES[0] and i in (1, len(lines) - 1))]
            for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
                found |= {(k, min(k + LONGEST, b)) for k in range(a, b, LONGEST)}
        units += [("\n".join(lines[a:b]), d, a, b) for a, b in found if b - a > 1]
    first, gone = {}, collections.defaultdict(set)
    for text, d, a, b in sorted(units, key=lambda u: (u[1], u[2], u[3] - u[2])):
        if WORD.search(text) and first.setdefault(text, (d, a, b)) != (d, a, b):
            gone[d] |= set(range(a, b))
    return {d: [x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]] for d, t in rows}


def test_line_dedup_like_brute_force(spark):
    """Passages of 2 to 40 lines in other surroundings, runs of equal lines, and what is left has every line of before."""
    rng = random.Random(12)
    fresh = lambda n: [f"own line {rng.random()}" for _ in range(n)]
    passages = {n: [f"passage {n} line {i} of some words" for i in range(n)] for n in (2, 3, 4, 6, 40)}
    rows, caught = [], collections.Counter()
    for i in range(60):
        n = rng.choice(list(passages))
        rows.append((i, "\n".join(fresh(rng.randint(1, 5)) + passages[n] + fresh(rng.randint(1, 5)) + ["equal"] * (70 * (i % 10 == 0)))))
    found = {r["doc_id"]: r["text"] for r in line_dedup(docs_of(spark, [(*r, None, None) for r in rows])).collect()}
    want = brute_dedup(rows)
    assert {d: t.split("\n") for d, t in found.items()} == {d: x or [""] for d, x in want.items()}
    assert {x for _, t in rows for x in t.split("\n")} == {x for t in found.values() for x in t.split("\n")}
    for d, t in rows:
        for n, lines in passages.items():
            caught[n, "all"] += n * (lines[0] in t)
            caught[n, "left"] += len(set(lines) & set(found[d].split("\n")))
    assert caught[40, "left"] < 0.2 * caught[40, "all"]  # the first one, and edges that surroundings hide
    assert caught[6, "left"] < 0.7 * caught[6, "all"]


def test_runs_and_slices_that_share_tasks(spark, monkeypatch):
    """Fewer tasks than runs or slices give the same rows."""
    from trialweave.llm import mixing

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(60)
    monkeypatch.setattr(mixing, "SLICE", 200)
    shown = lambda df: sorted(map(str, df.collect()))
    want = shown(fp.fingerprints(docs, 7)), shown(mix(docs, shards=2))
    for module in (fp, mixing):
        monkeypatch.setattr(module, "TASKS", 3)
    few = fp.fingerprints(docs, 7), mix(docs, shards=2)
    assert [df.rdd.getNumPartitions() for df in few] == [3, 2]
    assert tuple(map(shown, few)) == want
