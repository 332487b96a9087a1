"""Operators on whole tables against brute force on small, odd ones."""

import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from mirrortab.llm import components, decontaminate, near_dup, quality, records, sharding, url_filter, warc
from mirrortab.llm.scratch import new_path, saved

DOCS = "doc_id bigint, text string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows, schema=DOCS):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "'a' AS key", "'b' AS digest", "1 AS n", "2 AS uid", "'c' AS _key", "'d' AS kept", "5 AS row", "'e' AS n_words")


# quality

def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t ", "é" * 3 + " #*$ a\n" * 30, "one two three four five " * 9, "x"] + \
        ["".join(r.choice(["a ", "b ", "c ", "d ", "\n", "é ", "# ", "  ", "\r\n", "a b c d e "]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id but words", None), (3, texts[3], "s")]
    found = quality.verdicts(frame(spark, rows), "doc_id", "text", "source").collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found}
    assert all(got[i] == base_counts(t) for i, t in enumerate(texts))
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in found)
    assert quality.verdicts(frame(spark, rows).limit(0), "doc_id", "text", "source").count() == 0


def own(i, n=12):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_a_line_of_few_in_a_large_host_goes(spark):
    bar = "Subscribe to our weekly letter and never miss a story again"
    # Digits count as one, so the lines are told apart by letters.
    lettered = lambda i: own("".join(chr(97 + int(c)) for c in str(i)), 14)
    rows = [(i, f"{lettered(i)}\n{bar}" if i % 20 == 0 else lettered(i), "h") for i in range(1000)]
    rows += [(2000 + i, f"{lettered(2000 + i)}\n{bar}", "small") for i in range(20)]
    found = {r.doc_id: r.n_removed_words for r in quality.verdicts(frame(spark, rows), "doc_id", "text", "source").collect()}
    assert {i for i, n in found.items() if n} == set(range(0, 1000, 20)) and found[0] == len(bar.split())


def test_common_lines_go_and_depleted_documents_too(spark):
    bar = "Menu 1 | Home | About us and all the other links of the site"
    rows = [(i, f"{own('abcdefghijklmnopqrstuvwxyz'[i % 26] * (i // 26 + 1))}\n{bar.replace('1', str(i))}", "h") for i in range(60)]
    rows += [(100, bar, "h"), (101, bar, "other"), (102, None, "h")]
    copies = [(200 + i, own("copy", 30), "h") for i in range(40)]
    found = {r.doc_id: r for r in quality.verdicts(frame(spark, rows + copies), "doc_id", "text", "source").collect()}
    assert not found[100].kept and not found[100].base_failed and found[101].kept
    assert all(found[i].kept and found[i].n_removed_words == 15 for i in range(60))
    assert all(found[200 + i].kept for i in range(40))
    out = {r.doc_id: r for r in quality.cleaned(frame(spark, rows + copies + copies[:1]), "doc_id", "text", "source").collect()}
    assert out[7].text == rows[7][1].split("\n")[0] and out[101].text == bar and 100 not in out and out[7].digest == "b"


# decontamination

def contaminated_by_hand(docs, items, span=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            iw = words(t)
            size = min(span, len(iw))
            wins = {tuple(iw[k:k + size]) for k in range(len(iw) - size + 1)} if iw else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k:k + size]) in wins:
                    hit |= set(range(k, k + size))
                    if i is not None:
                        ids.add(str(i))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def test_shared_runs_are_found_whatever_their_place(spark):
    r = random.Random(4)
    vocabulary = ["a", "b", "c", "straße", "Ä", "x1", "the"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 13, 14, 12, 5, 1, 40, 25, 0])] + [(9, None), (None, own("null", 20)), (0, own("again", 15))]
    docs = []
    for d in range(60):
        body = [f"q{r.randint(0, 9)}" for _ in range(r.randint(0, 40))]
        source = r.choice([t for _, t in items if t]).split()
        a = r.randint(0, len(source) - 1)
        at = r.randint(0, len(body))
        body[at:at] = source[a:a + r.randint(1, 30)]
        docs.append((d, r.choice([" ", "-", "\n", "! "]).join(body)))
    docs += [(60, None), (61, ""), (62, "?!"), (63, "a b c " * 5000)]
    want = contaminated_by_hand(docs, items)
    found = decontaminate.contamination(frame(spark, [(*d, "s") for d in docs]), "doc_id", "text",
                                        spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found} == want
    clean = decontaminate.clean_rows(frame(spark, [(*d, "s") for d in docs]), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    assert sorted(r.doc_id for r in clean.collect()) == [d for d, (n, h, _) in sorted(want.items()) if not (h and 20 * h >= n)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(frame(spark, [(1, own(1), "s")] * 2), "doc_id", "text", none, "item_id", "text").where("n_hit = 0").count() == 2
    assert decontaminate.contamination(frame(spark, [], DOCS), "doc_id", "text", none, "item_id", "text").count() == 0


# near duplicates

def groups_by_hand(rows, shingle, similar=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return frozenset([tuple(w)] if 0 < len(w) < shingle else [tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)])
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similar * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("shingle", [2, 5])
def test_components_are_those_of_all_pairs(spark, shingle):
    r = random.Random(shingle)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 6, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            copy = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                copy[r.randrange(len(copy))] = f"z{r.randint(0, 99)}"
            words = copy if r.random() < 0.5 else words  # chains, not only stars
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), (5, rows[5][1]), (n + 3, rows[0][1].upper())]
    found = near_dup.groups(frame(spark, [(*x, "s") for x in rows]), "doc_id", "text", shingle=shingle).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=order) == sorted(groups_by_hand(rows, shingle), key=order)
    left = near_dup.one_per_group(frame(spark, [(*x, "s") for x in rows]), "doc_id", "text", shingle=shingle).collect()
    assert sorted(x.doc_id for x in left) == sorted({c for d, s, c in groups_by_hand(rows, shingle) if s} | {n, n + 1, n + 2})
    assert near_dup.groups(frame(spark, rows[:0], DOCS), "doc_id", "text").count() == 0


def similarity(a, b):
    return len(a & b) / len(a | b)


def varied(words, share, r, tag):
    copy = list(words)
    for at in r.sample(range(len(copy)), int(len(copy) * share)):
        copy[at] = f"{tag}{r.randint(0, 10**9)}"
    return copy


def test_pairs_at_the_threshold_are_all_found(spark):
    """Recall against brute force on pairs at a similarity of 0.80 to 0.85."""
    r, rows, want = random.Random(17), [], 0
    while want < 400:
        words = [f"w{want}x{k}" for k in range(r.randint(40, 200))]
        copy = varied(words, r.choice([0.03, 0.04, 0.05]), r, "z")
        sets = [{tuple(w[i:i + 2]) for i in range(len(w) - 1)} for w in (words, copy)]
        if 0.80 <= similarity(*sets) <= 0.85:
            rows += [(2 * want, " ".join(words)), (2 * want + 1, " ".join(copy))]
            want += 1
    found = {g.doc_id: g.component_id for g in near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", shingle=2).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(want)) == want and all(found[2 * i] == 2 * i for i in range(want))


def test_many_texts_just_below_the_threshold(spark, monkeypatch):
    """A group whose pairs share buckets but hardly any links, with links hidden in it, in tiles."""
    monkeypatch.setattr(near_dup, "TILE", 50)
    r = random.Random(23)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(varied(base, 0.065, r, "z"))) for i in range(260)]
    rows += [(300 + i, " ".join(varied(rows[i * 9][1].split(), 0.02, r, "y"))) for i in range(25)]
    out = near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", shingle=2)
    want = {d: c for d, _, c in groups_by_hand(rows, 2)}
    assert {g.doc_id: g.component_id for g in out.collect()} == want and 20 < len(set(want.values())) < 280


def test_links_of_a_block_by_hand():
    import pyarrow as pa
    r = random.Random(29)
    base = [f"b{k}" for k in range(60)]
    texts = [" ".join(varied(base, r.choice([0.0, 0.02, 0.04, 0.07, 0.2]), r, "z")) for _ in range(90)]
    sets = near_dup.Sets(pa.array(texts), 2)
    regs, n = sets.sketches(near_dup.REGISTERS), sets.sizes
    members = [set(sets.keys[a:b].tolist()) for a, b in zip(sets.cuts[:-1], sets.cuts[1:])]
    block, root = np.array([i // 45 for i in range(90)]), np.array([i % 30 for i in range(90)])
    for split in (0, 40):
        got = near_dup.joining_links(block, root, n, regs, sets.keys, sets.cuts, 80, split)
        allowed = [(i, j) for i in range(90) for j in range(i + 1, 90) if block[i] == block[j] and (not split or i < split <= j)
                   and len(members[i] & members[j]) * 100 >= 80 * len(members[i] | members[j])]
        assert set(got) <= set(allowed) and all(root[i] != root[j] for i, j in got)

        def parts(pairs):
            top = {x: x for x in range(30)}
            find = lambda x: x if top[x] == x else find(top[x])
            for i, j in pairs:
                top[find(root[i])] = find(root[j])
            return sorted(sorted(y for y in range(30) if find(y) == find(x)) for x in range(30))
        assert parts(got) == parts(allowed) and len(got) < 30 and got


def test_estimate_is_near_the_truth_after_chance_is_taken_off():
    import pyarrow as pa
    r = random.Random(9)
    for share in (0.0, 0.5, 0.8, 0.95):
        words = [f"w{r.random()}" for _ in range(3000)]
        other = words[:int(3000 * share)] + [f"v{r.random()}" for _ in range(3000 - int(3000 * share))]
        s = near_dup.Sets(pa.array([" ".join(words), " ".join(other)]), 2)
        regs = s.sketches(near_dup.REGISTERS)
        truth = len(np.intersect1d(s.keys[:s.cuts[1]], s.keys[s.cuts[1]:])) / len(np.union1d(s.keys[:s.cuts[1]], s.keys[s.cuts[1]:]))
        assert abs(near_dup.estimated(regs[:1], regs[1:], s.sizes[:1], s.sizes[1:])[0] - truth) < 0.15


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (1, 0), (300, 200)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 300: 200, 200: 200}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# record files

def test_records_round_trip(spark):
    from tokenizers import Tokenizer
    path = P.path(records.VOCABULARY)
    texts = [None, "", "Hello World!", "x " * 20000, "Hello World!", "<|endoftext|> a"]
    rows = [(5, texts[0], "s"), (3, texts[1], "s"), (9, texts[2], "s"), (1, texts[3], "s"), (9, texts[4], "s"), (None, texts[5], "s")]
    target = new_path(spark, "test-records")
    manifest = records.write_records(frame(spark, rows), "doc_id", "text", path, target, file_bytes=30_000)
    assert manifest.count() > 1
    got = sorted(records.read_records(manifest, target, ids=True).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, 1, 3, 5, 9, 9]
    t, start = Tokenizer.from_file(path), 0
    for r, text in zip(got, [texts[5], texts[3], "", "", texts[2], texts[2]]):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids), ids.tobytes())
        start += len(ids)
    last = manifest.orderBy(F.desc("part"), F.desc("piece")).first()
    again = records.read_at(target, last["data"], last["offsets"], [last["docs"] - 1, 0], last["width"])
    assert again[0].astype("<u4").tobytes() == bytes(got[-1].ids)
    empty = records.write_records(frame(spark, [], DOCS), "doc_id", "text", path, target)
    assert records.read_records(empty, target).count() == 0


def test_damage_is_noticed():
    good = records.framed(b"abcd") + records.framed(b"")
    stream = io.BytesIO(good)
    assert [records.unframed(stream) for _ in range(3)] == [b"abcd", b"", None]
    for i in range(len(records.framed(b"abcd"))):
        bad = bytearray(records.framed(b"abcd"))
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframed(io.BytesIO(bytes(bad)))


# archives

def test_archives_round_trip(spark):
    big = "".join(chr(97 + i % 26) + ("é" if i % 7 else "WARC/1.1\r\n") for i in range(60000))
    rows = [(1, "http://a/1", "x" * 1000), (4, "http://a/4", "x" * 1000), (9, None, "x" * 1000), (2, "u v\r\n", "x" * 999), (3, "u", "x" * 999),
            (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "x" * 1000), (8, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS key", "'z' AS digest", "'q' AS body")
    target = new_path(spark, "test-warc")
    manifest = warc.write_archives(pages, "page_id", "url", "html", target, segment_bytes=4000, file_bytes=20_000)
    read = saved(warc.read_archives(manifest, target))
    assert read.where("type = 'continuation'").count() > 5 and manifest.count() > 1
    found = warc.resolved(warc.payloads(warc.reassembled(read))).collect()
    import hashlib
    got = sorted((r.key or 0, r.type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found)
    top = {"x" * 1000: 9, big: 8}
    want = sorted((k or 0, "revisit" if h in top and k != top[h] else "response", top[h] if h in top and k != top[h] else None,
                   len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in rows)
    assert got == want
    lost = warc.reassembled(read.where("number IS NULL OR number != 2"))
    assert lost.where("origin IS NOT NULL AND block IS NOT NULL").count() == 0
    assert warc.write_archives(pages.limit(0), "page_id", "url", "html", target).count() == 0


def test_chunked_framing():
    for body in (b"", b"a", b"x" * 20001):
        assert warc.dechunked(warc.chunked(body, 1000)) == body
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    plain = b"".join([warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<a>")], b"1\r\n\r\n2"), warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<b>")], b"")])
    assert [b for _, b in warc.records_in(io.BytesIO(plain))] == [b"1\r\n\r\n2", b""]


# address lists

def test_entries_hold_from_their_day_to_the_next_change(spark):
    entries = [("example.com", "block", 10), ("example.com", "block", 12), ("example.com", "remove", 20), ("news.example.com", "allow", 15),
               ("http://news.example.com/bad", "BLOCK", 16), ("tie.org", "allow", 5), ("tie.org", "block", 5), (None, "block", 1), ("x", None, 1), ("x", "block", None)]
    asked = {(1, "http://example.com/a", 9): None, (2, "http://example.com/a", 10): "example.com", (3, "HTTP://WWW.Example.com:80/a#f", 19): "example.com",
             (4, "http://example.com/a", 20): None, (5, "http://news.example.com/bad", 15): "news.example.com", (6, "http://news.example.com/bad#x", 16): "http://news.example.com/bad",
             (7, "http://tie.org", 5): "tie.org", (8, None, 10): None, (9, "no address", 10): None, (10, "http://example.com/", None): None, (11, "http://notexample.com/", 11): None}
    captures = spark.createDataFrame(list(asked) + [(2, "http://example.com/a", 10)], "page_id int, url string, at int").selectExpr("*", "1 AS ident", "2 AS level")
    lists = spark.createDataFrame(entries, "key string, action string, since int")
    found = url_filter.judged(captures, "page_id", "url", "at", lists, "key", "action", "since").collect()
    assert {(r.page_id, r.url, r["at"]): r.matched for r in found} == asked
    assert {r.page_id for r in found if r.blocked} == {2, 3, 6, 7}
    assert url_filter.judged(captures, "page_id", "url", "at", lists.limit(0), "key", "action", "since").where("blocked").count() == 0
    assert url_filter.judged(captures.limit(0), "page_id", "url", "at", lists, "key", "action", "since").count() == 0


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "timestamp_ntz"])
def test_as_of_join_equals_a_search_through_all_entries(spark, kind, monkeypatch):
    import random

    from mirrortab.operators import ordering
    monkeypatch.setattr(url_filter.skew_join, "__defaults__", ("inner", None, 1000, 50))
    assert ordering.skew_join is url_filter.skew_join
    draw = random.Random(5)
    domains = ["hot.org", "org", "a.hot.org", "b.net", "c.b.net", "lone.net"]
    # Some 40 days of seconds for clock types, so that a key has entries and captures in many cells, and cells with none.
    span = 300 if kind in ("int", "date") else 3_500_000
    entries = [(draw.choice(domains[:5]), draw.choice(["block", "allow", "remove"]), draw.randrange(span)) for _ in range(400)]
    captures = [(i, f"http://{'hot.org' if i % 3 == 0 else draw.choice(domains)}/{i % 7}", draw.randrange(span)) for i in range(1500)]
    to_time = {"int": "CAST({} AS int)", "date": "date_add(DATE'2024-01-01', CAST({} AS int))", "timestamp": "timestamp_seconds({})",
               "timestamp_ntz": "CAST(timestamp_seconds({}) AS timestamp_ntz)"}[kind]
    # Lists count in a wider type than captures where there is one.
    lists = spark.createDataFrame(entries, "key string, action string, t long").selectExpr("key", "action", ("t" if kind == "int" else to_time.format("t")) + " AS since")
    asked = spark.createDataFrame(captures, "ident long, url string, t long").selectExpr("ident", "url", to_time.format("t") + " AS at", "t")
    found = url_filter.judged(asked, "ident", "url", "at", lists, "key", "action", "since")
    assert found.schema["at"].dataType == asked.schema["at"].dataType
    strict = {"block": 2, "allow": 1, "remove": 0}
    log = {}
    for k, action, t in entries:
        log.setdefault(k, {})[t] = max(log.get(k, {}).get(t, 0), strict[action])

    def decided(url, t):
        host = url.split("/")[2]
        for k in [host.split(".", i)[i] for i in range(host.count(".") + 1)]:
            past = [u for u in log.get(k, {}) if u <= t]
            if past and log[k][max(past)]:
                return k, "block" if log[k][max(past)] == 2 else "allow"
        return None, None

    assert {r.ident: (r.matched, r.action) for r in found.collect()} == {i: decided(u, t) for i, u, t in captures}


# shards

def sharded(spark, keys, shards):
    rows = saved(spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "uid bigint, link bigint, n0 string").coalesce(2))
    out = sharding.balanced_shards(rows.drop("link"), rows.select("uid", "link"), shards).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(out) == len(keys) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    where = {}
    for r in out:
        if keys[r.uid] is not None:
            where.setdefault(keys[r.uid], []).append(r.shard)
    return where


def test_linked_rows_stay_together_where_they_fit(spark):
    where = sharded(spark, [i // 3 if i < 300 else None for i in range(1000)], 16)
    assert all(len(set(s)) == 1 for s in where.values())
    where = sharded(spark, [1] * 400 + [2 + i // 2 for i in range(100)] + [None] * 500, 8)
    assert len(set(where[1])) <= 5 and sum(len(set(s)) > 1 for k, s in where.items() if k != 1) <= 3


def test_shards_of_few_or_no_rows(spark):
    sharded(spark, [1, 1, None], 16)
    sharded(spark, [], 4)
    sharded(spark, [1] * 64, 4)


def test_small_keys_stay_whole_beside_a_hot_one_and_without_free_rows(spark):
    where = sharded(spark, [1] * 2800 + [2 + i // 2 for i in range(2000)] + [None] * 3392, 8)
    assert sum(len(set(s)) > 1 for k, s in where.items() if k != 1) == 0 and len(set(where[1])) <= 4
    where = sharded(spark, [i // 2 for i in range(4096)], 4)
    assert all(len(set(s)) == 1 for s in where.values())
