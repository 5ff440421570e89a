import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from strandframe.llm import langid, lm_score, media, quality_ledger, queries, url_templates

DATA = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t ", "1 2 3", "a", "a b c a b c a b c", "# * $ % & | < >", "x " * 3000, "Ä\u00a0ö\x0bü", "l\nl\n\nl\n \nm", "no no no no", "!! !!", "\x85 \x1c", "日本語 テキスト " * 30]


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", 1, "w", "l", "t", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, words string, lines string, taken string, fail_bits int").repartition(3)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [*AWKWARD, *[r.text for r in docs.collect()]]
    rows = {r.doc_id: r for r in quality_ledger.verdicts(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, dups, repeats = want = plain_measures(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_sql_and_no_python(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.op4_quality_ledger(spark, DATA)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
    names = sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({quality_ledger.verdict_sql()})").fetchall())
    assert got == want


def test_ablations_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = queries.quality_ablations(spark, DATA)
    got = sorted(tuple(r[c] for c in ("rule", "n_failed", "n_failed_alone", "n_passed_without")) for r in df.collect())
    assert got == sorted(con.sql(f"SELECT rule, n_failed, n_failed_alone, n_passed_without FROM ({quality_ledger.ablation_sql()})").fetchall())


def test_quality_policies_and_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (4,), (4,), (12,), (16,)], "fail_bits long")
    got = {r.rule: tuple(r)[1:] for r in quality_ledger.ablations(rows, "v1").collect()}
    assert got == {"few_words": (2, 1, 3), "repeated_words": (1, 0, 2), "symbols": (3, 2, 4), "shouting": (1, 0, 2)}
    assert [r.k for r in rows.select(quality_ledger.passes("base").alias("k")).collect()] == [True, False, False, True, True, True, True]


def test_kept_documents(spark):
    docs = frame(spark, [*AWKWARD, " ".join(f"w{i}" for i in range(60))])
    out = quality_ledger.kept_documents(docs)
    assert out.schema == docs.schema
    assert [r.doc_id for r in out.collect()] == [len(AWKWARD)]
    assert quality_ledger.kept_documents(docs.where("false")).count() == 0


def test_labelled_clean_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op4_quality_ledger(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = found.where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) <= 0.05 * len(bad)


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_language_codes(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_learns_from_training_rows_only(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    a, b = (langid.fit(d.where(~langid.held_out())) for d in (docs, other))
    assert a.langs == b.langs and (a.weights == b.weights).all()


def test_language_of_awkward_texts(spark):
    model = langid.fit_counts(
        ["en", "fr"], np.array([np.bincount(np.concatenate(list(langid.features(t))), minlength=langid.FEATURES) for t in ("the cat and the dog", "le chat et le chien")])
    )
    got = {r.doc_id: r for r in langid.predict(frame(spark, AWKWARD), model).collect()}
    for i, t in enumerate(AWKWARD):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    assert got[0].score == 0.0
    kept = langid.known_documents(frame(spark, AWKWARD), model)
    assert kept.columns == frame(spark, AWKWARD).columns and 0 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len(code) == n and len({tuple(c) for c in code}) == n
    if n > 2:
        least = min((a != b).sum() for k, a in enumerate(code) for b in code[:k])
        assert least >= code.shape[1] // 4


def test_language_without_training(spark):
    model = langid.fit(frame(spark, ["a"]).where("false"))
    assert [r.lang_pred for r in langid.predict(frame(spark, ["abc", None]), model).collect()] == ["und", "und"]


def test_without_labels_no_text_with_letters_goes(spark):
    model = langid.fit(frame(spark, ["a"]).where("false"))
    kept = langid.known_documents(frame(spark, ["abc", None, "12 3", "", "ñ"]), model).collect()
    assert [r.text for r in kept] == ["abc", "ñ"]


def plain_features(text):
    clean = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not any(c.isalpha() for c in clean):
        return []
    padded = f" {clean} ".ljust(4)
    out = []
    for i in range(len(padded) - 3):
        h = 0
        for c in padded[i : i + 4]:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % (1 << 64)
            h ^= h >> 29
        out.append(h % (1 << 17))
    return out


def test_language_equals_a_plain_version(spark):
    """Counts, codes, classifiers and decoding again in plain Python, over the whole table."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    learned = {(lang, t) for i, t, lang in docs if lang is not None and t is not None and not held[i]}
    langs = sorted({lang for lang, _ in learned})
    n = {lang: Counter() for lang in langs}
    for lang, t in learned:
        n[lang].update(plain_features(t))
    size = 1 << 17
    total = {lang: sum(n[lang].values()) + 0.5 * size for lang in langs}
    # every split of the languages once, the first language always on the side of +1
    splits = [(1, *x) for x in itertools.product((1, -1), repeat=len(langs) - 1) if -1 in x]
    bits = []
    for code in splits:
        def odds(g, code=code):
            side = {s: [(n[lang][g] + 0.5) / total[lang] for lang, c in zip(langs, code, strict=True) if c == s] for s in (1, -1)}
            return math.log(sum(side[1]) / len(side[1])) - math.log(sum(side[-1]) / len(side[-1]))

        rest = odds(-1)  # of an n-gram that no language has
        seen = {g: odds(g) for g in set().union(*n.values())}
        means = [sum((n[lang][g] + 0.5) / total[lang] * w for g, w in seen.items()) + (size - len(seen)) * 0.5 / total[lang] * rest for lang in langs]
        low = min(m for m, c in zip(means, code, strict=True) if c > 0)
        high = max(m for m, c in zip(means, code, strict=True) if c < 0)
        bits.append((code, seen, rest, (low + high) / 2, max(low - high, 1e-6)))
    worth = sum(b[4] for b in bits)
    got = {r.doc_id: r for r in queries.op5_language_codes(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        found = plain_features(t or "")
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        loss = [0.0] * len(langs)
        for code, seen, rest, centre, gap in bits:
            s = sum(seen.get(g, rest) - centre for g in found) / len(found) * 4 / gap
            for k, c in enumerate(code):
                loss[k] += gap / worth * len(bits) * math.log1p(math.exp(-c * s))
        best = min(range(len(langs)), key=loss.__getitem__)
        p = 1 / sum(math.exp(loss[best] - x) for x in loss)
        assert got[i].lang_pred == langs[best] and abs(got[i].score - p) < 1e-4, i
        assert got[i].held_out == held[i]


def plain_pairs(payload):
    """Times and codes by a Fourier sum written out."""
    angle = -2j * math.pi / 192
    waves = np.exp(angle * np.outer(np.arange(192), np.arange(97)))
    tops = []
    for a in range(0, len(payload), 192):
        frame_of = [(payload[a + j] - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * j / 191)) for j in range(192)]
        power = np.abs(np.array(frame_of) @ waves)
        tops.append([])
        for low, high in ((1, 6), (6, 12), (12, 24), (24, 48), (48, 97)):
            k = max(range(low, high), key=lambda b: power[b])
            tops[-1].append(k if power[k] > power[1:].mean() else 0)
    out = []
    for t, own in enumerate(tops):
        for step in (1, 2):
            if t + step < len(tops):
                for k, a in enumerate(own):
                    out += [(t, (a * 128 + b) * 4 + step) for b in tops[t + step][k : k + 2] if a and b]
    return sorted(out)


def test_media_features_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.feature for r in queries.op6_media_columns(spark, DATA).collect()}
    assert len(got) == len(docs)
    for r in docs:
        found = plain_pairs(media.payload_of(r.text)[1])
        raw = b"".join(t.to_bytes(4, "little") for t, _ in found) + b"".join(c.to_bytes(4, "little") for _, c in found)
        assert got[r.doc_id] == f"{len(found)}:{xxhash.xxh64(raw).hexdigest()}", r.doc_id


def test_media(spark):
    texts = [*AWKWARD, "é" * 96, "a" * 192, "a" * 193]
    got = {r.doc_id: r for r in media.media_digests(media.media_table(frame(spark, texts))).collect()}
    stored = {r.doc_id: r for r in media.media_table(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r, s = got[i], stored[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert media.from_wav(bytes(s.media)) == payload
        assert (r.media_bytes, r.media_sha256) == (len(s.media), hashlib.sha256(bytes(s.media)).hexdigest())
        assert list(s.times) == sorted(s.times) and len(s.times) == len(s.codes) == int(r.feature.split(":")[0])
    assert len({r.feature for i, r in got.items() if not (texts[i] or "").strip(" ")}) <= 2
    assert media.media_digests(media.media_table(frame(spark, ["a"]).where("false"))).count() == 0


def test_peaks_find_a_tone():
    t = np.arange(192 * 20)
    for k in (3, 9, 30):
        tone = (128 + 100 * np.sin(2 * np.pi * k * t / 192)).astype(np.uint8)
        assert (media.peaks(tone) == k).any(axis=1).all()
    a, b = media.fingerprint(tone.tobytes()), media.fingerprint(tone[: 192 * 10].tobytes())
    assert set(zip(*map(np.ndarray.tolist, b), strict=True)) <= set(zip(*map(np.ndarray.tolist, a), strict=True))


URLS = [
    "http://A.Example.com/en/7?x", "https://example.com/en/1", "http://badexample.com/en/9", "http://com/en/", "ftp://x.net/de/8", "http://example.net/de/8.html#t", "http://b.example.net/de/81", "http://q.org/es/",
    "http://q.org", "http://q.org?en/es/", None, "", "no scheme", "://", "http://h/1/2/3/4/5/6/7", "http://Ä.ORG/es/é", "x://y://z/w", "http://com.evil/en/", "http://example.com/EN/7",
]


def plain_url(url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    df = url_templates.judge(pages)
    got = {r.page_id: r for r in df.collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, best = plain_url(u)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (best[1] if best else None), u
        assert got[i].verdict == (best[0] if best else "allow"), u
    assert url_templates.judge(pages.where("false")).count() == 0
    doubled = url_templates.judge(pages.union(pages))
    assert doubled.count() == 2 * len(URLS)


def plain_templates(rows):
    """host, path, bad (or None) to the paths that are rejected; the method again, without Spark."""
    def segs(path):
        return tuple(re.sub(r"^[0-9]+(?=$|\.[a-z]+$)", "*", s) for s in re.sub("^/", "", path).split("/"))

    paths = {(h, segs(p)) for h, p, _ in rows}
    template = dict.fromkeys(paths, ())
    for level in range(max(len(s) for _, s in paths)):
        kids = {}
        for h, s in paths:
            if len(s) > level:
                kids.setdefault((h, template[h, s]), set()).add(s[level])
        template = {(h, s): t + (("*" if len(kids[h, t]) > url_templates.MOST_CHILDREN else s[level],) if len(s) > level else ()) for (h, s), t in template.items()}
    n, k, own, bad_own = (Counter() for _ in range(4))
    for h, p, bad in rows:
        t = template[h, segs(p)]
        if bad is not None:
            own[h, t] += 1
            bad_own[h, t] += bad
            for j in range(len(t) + 1):
                n[h, t[:j]] += 1
                k[h, t[:j]] += bad

    def branch(h, t):
        """The node itself or the nearest one above that differs from its own parent."""
        while t:
            if n[h, t]:
                share = k[h, t[:-1]] / n[h, t[:-1]]
                if abs(k[h, t] / n[h, t] - share) > 1.96 * math.sqrt(share * (1 - share) / n[h, t]) + 1e-9:
                    return h, t
            t = t[:-1]
        return h, t

    ends = {(h, t): branch(h, t) for (h, _), t in template.items()}
    bn, bk = Counter(), Counter()
    for at, b in ends.items():
        bn[b] += own[at]
        bk[b] += bad_own[at]
    gone = {at for at, b in ends.items() if bn[b] >= 5 and (bk[b] + 4 * k[at[0], ()] / max(1, n[at[0], ()])) / (bn[b] + 4) >= 0.8}
    return {(h, p) for h, p, _ in rows if (h, template[h, segs(p)]) in gone}


def test_templates_equal_a_plain_version(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        host = rng.choice(["a.x", "b.x", "c.x"])
        part = rng.choice(["ads", "news", "shop"])
        leaf = rng.choice([str(rng.randint(1, 999)), f"u{rng.randint(1, 200)}", f"{rng.randint(1, 9)}.html", "p/q/r/s/t"])
        label = None if rng.random() < 0.6 else int(rng.random() < {"ads": 0.95, "news": 0.03, "shop": 0.5}[part])
        rows.append((i, f"http://{host}/{part}/{leaf}", label))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, bool(b)) for i, _, b in rows if b is not None], "page_id long, bad boolean")
    got = {(r.host, r.path): r.verdict for r in url_templates.judge(pages, (), labels).collect()}
    gone = plain_templates([(*plain_url(u)[:2], b) for _, u, b in rows])
    assert gone and {k for k, v in got.items() if v == "block"} == gone
    assert all("ads" in p for _, p in gone)


def test_templates_decide_pages_without_a_rule(spark):
    """On the table: pages of hosts whose labelled pages are nearly all blocked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_templates.judge(pages).collect()
    gone = {(r.host, r.path) for r in rows if r.rule is None and r.verdict == "block"}
    said = {r.page_id: r.verdict == "block" for r in rows if r.rule}
    plain = plain_templates([(r.host, r.path, said.get(r.page_id)) for r in rows])
    assert gone and gone == {(r.host, r.path) for r in rows if r.rule is None and (r.host, r.path) in plain}


def test_templates_of_deep_and_odd_paths(spark):
    urls = ["http://h/" + "/".join(["a"] * 9 + [str(i)]) for i in range(30)] + ["http://h", "http://h/", "http://h//", "http://h/a//b", None, "none"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i in range(12)] + [(30, False), (31, False), (32, False)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in url_templates.judge(pages, (), labels).collect()}
    assert all(got[i] == "block" for i in range(30)) and all(got[i] == "allow" for i in (34, 35))


def test_url_plan_has_no_python(spark):
    plan = queries.op7_url_templates(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_lm(docs, good, size):
    tok = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    counts = Counter(w for x in tok.values() for w in x)
    classes = {w: (n.bit_length() - 1, (n * 16 >> (n.bit_length() - 1)) - 16) for w, n in counts.items()}
    for least in sorted(set(classes.values())):
        vocab = sorted(w for w, c in classes.items() if c >= least)
        if len(vocab) <= size - 2:
            break
    else:
        vocab = []
    of = {w: k + 2 for k, w in enumerate(vocab)}
    ids = {i: [1, *[of.get(w, 0) for w in x]] for i, x in tok.items()}
    out = {}
    models = []
    for own in (good, set(docs)):
        uni, hist, bi = Counter(), Counter(), Counter()
        for i in own:
            for a, b in zip(ids[i], ids[i][1:], strict=False):
                uni[b] += 1
                hist[a] += 1
                bi[a, b] += 1
        models.append((uni, hist, bi, sum(uni.values()) + len(vocab) + 1))
    for i, x in ids.items():
        loss = []
        for uni, hist, bi, total in models:
            each = []
            for a, b in zip(x, x[1:], strict=False):
                trust = hist[a] / (hist[a] + 8)
                each.append(-math.log(trust * bi[a, b] / max(1, hist[a]) + (1 - trust) * (uni[b] + 1) / total))
            loss.append(sum(each) / len(each) if each else 0.0)
        out[i] = (len(x) - 1, *loss)
    return out


def test_lm_scores_equal_a_plain_version(spark):
    rng = random.Random(7)
    docs = {i: " ".join(rng.choice(["a", "b", "c", "D", "d", "é", "f" + str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 30))) for i in range(60)}
    docs |= {60: None, 61: "", 62: " \n", 63: docs[0], 64: "zz"}
    good = {i for i in docs if i % 3 == 0}
    df = frame(spark, list(docs.values()), list(docs))
    scorer = lm_score.fit(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), size=12, slots=1 << 20)
    got = {r.doc_id: r for r in lm_score.score(df, scorer).collect()}
    want = plain_lm(docs, good, 12)
    for i in docs:
        n, target, background = want[i]
        assert got[i].n_tokens == n
        assert got[i].loss_target == pytest.approx(target, abs=1e-6) and got[i].loss_background == pytest.approx(background, abs=1e-6)
        assert got[i].score == pytest.approx(target - background, abs=1e-6)


def test_lm_of_no_rows(spark):
    df = frame(spark, ["a"]).where("false")
    scorer = lm_score.fit(df, spark.createDataFrame([], "doc_id long"), size=16, slots=64)
    assert lm_score.score(df, scorer).count() == 0
    assert lm_score.score(frame(spark, ["x y", None]), scorer).count() == 2
