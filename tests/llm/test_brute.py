"""The quality model, the fusion of languages, the Jaccard join and the whole pipeline against plain Python."""

import collections
import hashlib
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadloom.llm import bpe, common, jaccard, language, mixing, pii, quality
from loadloom.llm.url_filter import host_and_path

N = quality.ORDER


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes, with dictionaries."""

    def __init__(self, texts):
        self.counts = {N: collections.Counter()}
        for t in texts:
            padded = b"\0" * (N - 1) + t
            for i in range(len(t)):
                self.counts[N][padded[i : i + N]] += 1
        for k in range(N - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.contexts, self.known = {}, {}, {}
        for k, table in self.counts.items():
            n = [sum(v == i for v in table.values()) for i in (1, 2, 3, 4)]
            d = []
            for i in range(3):
                if n[i] and n[0]:
                    y = n[0] / (n[0] + 2 * n[1])
                    d.append(max(0.05, min(i + 0.95, (i + 1) - (i + 2) * y * n[i + 1] / n[i])))
                else:
                    d.append(0.5 * (i + 1))
            self.discounts[k] = d
            by = collections.defaultdict(list)
            for g, c in table.items():
                by[g[:-1]].append(c)
            self.contexts[k] = {h: (sum(cs), sum(d[min(c, 3) - 1] for c in cs) / sum(cs)) for h, cs in by.items()}

    def p(self, gram):
        if not gram:
            return 1 / 256
        if gram not in self.known:
            k, low = len(gram), self.p(gram[1:])
            total, weight = self.contexts[k].get(gram[:-1], (1, 1.0))
            c = self.counts[k].get(gram, 0)
            self.known[gram] = (c - self.discounts[k][min(c, 3) - 1] if c else 0) / total + weight * low
        return self.known[gram]

    def nll(self, text):
        padded = b"\0" * (N - 1) + text
        return -sum(math.log(self.p(padded[i : i + N])) for i in range(len(text)))


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, nulls left out."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_quality(rows, trusted):
    """Kept rows of (id, text, lang)."""
    held = lambda i: spark_hash(i) % quality.FOLDS == 0
    models, scores, limits, means = {}, {}, {}, {}
    for lang in {r[2] for r in rows}:
        learn = [r[1].encode() for r in rows if r[2] == lang and r[0] in trusted and r[1] and not held(r[0])]
        if learn:
            models[lang] = PlainKneserNey(learn)
    for r in rows:
        if r[1] and r[2] in models:
            scores[r] = models[r[2]].nll(r[1].encode())
    for lang in models:
        fresh = [r for r in rows if r[2] == lang and r[0] in trusted and held(r[0]) and r in scores]
        if fresh:
            means[lang] = sum(scores[r] for r in fresh) / sum(len(r[1].encode()) for r in fresh)
            drawn = sorted(math.exp((scores[r] + quality.PRIOR_BYTES * means[lang]) / (len(r[1].encode()) + quality.PRIOR_BYTES)) for r in fresh)
            limits[lang] = drawn[max(0, math.ceil(quality.UPPER * len(drawn)) - 1)]
    kept = []
    for r in rows:
        if not r[1]:
            continue
        if r[2] in limits and math.exp((scores[r] + quality.PRIOR_BYTES * means[r[2]]) / (len(r[1].encode()) + quality.PRIOR_BYTES)) > limits[r[2]] * (1 + 1e-12):
            continue
        kept.append(r)
    return kept


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


VOCABULARY = [a + b + c for a in ("ba", "ke", "mi", "lo", "ru") for b in ("na", "te", "so", "li", "dra") for c in ("m", "r", "st", "n", "")]


def corpus(rng):
    """(id, text, lang, source) with nulls, empty and odd texts, repeated ids and rows, exact and near copies, personal data and junk."""
    rows = []
    for i in range(90):
        rows.append([i, words(rng, rng.randrange(12, 60), VOCABULARY), ("xx", "yy", None)[i % 3], ("a", "b", "c", None)[i % 4]])
    for i in range(90, 130):
        base = rows[rng.randrange(30)][1].split()
        if i % 2:
            base[rng.randrange(len(base))] = "changed"
        rows.append([i, " ".join(base), "xx", "b"])
    for i in range(130, 150):
        rows[i - 130][1] += f" mail {rows[i % 7][1].split()[0]}{i}@some{i}.org or +1 (375) 555-{1000 + i} now"
        rows.append([i, "".join(rng.choice("#$%{}<>|~^QXZJ0987") for _ in range(rng.randrange(40, 200))), ("xx", "yy")[i % 2], "a"])
    rows += [[3, words(rng, 30, VOCABULARY), "xx", "a"], [4, rows[4][1], rows[4][2], "c"], [None, rows[5][1], "yy", "b"], [None, words(rng, 25, VOCABULARY), "yy", "b"], [None, words(rng, 25, VOCABULARY), "yy", None]]
    rows += [[200, None, "xx", "a"], [201, "", "xx", "a"], [202, "  ", None, "a"], [203, "kenar", "zz", "c"], [204, "kenar", "zz", "c"], [205, words(rng, 1500, VOCABULARY), "xx", "a"]]
    return [tuple(r) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def plain_shingles(text):
    w = common.re.findall(common.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes_of(texts):
    """The number of the component of each text, None without shingles."""
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) if s else None for i, s in enumerate(sets)]


def plain_near_duplicates(rows):
    groups = collections.defaultdict(list)
    for r, c in zip(rows, classes_of([r[1] for r in rows]), strict=True):
        # Texts without shingles: rows of an id and a text are one, null ids are apart.
        groups[("set", c) if c is not None else ("row", r[0], r[1]) if r[0] is not None else ("own", len(groups))].append(r)
    order = lambda r: (r[0] is None, r[0] or 0, spark_hash(r[1]) if r[1] is not None else 42)
    out = []
    for members in groups.values():
        best = min(map(order, members))
        out.append(min((r for r in members if order(r) == best), key=lambda r: (r[2] or "", r[3] or "")))
    return out


def plain_mix(rows):
    """Each row as often as the mix takes it."""
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_ = {}, {s for s in order}
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    target |= share
    out = []
    for s in order:
        start = 0
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0, len((r[1] or "").split())))
        for r in mine:
            n = len((r[1] or "").split())
            out += [r] * sum(j * sizes[s] + start + n / 2 < target[s] for j in range(3))
            start += n
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    rng = random.Random(5)
    rows = corpus(rng)
    trusted = {i for i in range(90)} | {300}
    d = str(tmp_path)
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in trusted] + [(i, 0, 0) for i in range(130, 150)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")

    def as_rows(df):
        return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=repr)

    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = docs.withColumn("_hash", F.lit(1)).withColumn("_id", F.lit("x"))
    kept = [r[:4] for r in rows if r[:3] in {*plain_quality([r[:3] for r in rows], trusted)}]
    one = p.keep_quality(spark, docs, d)
    assert as_rows(one) == sorted(kept, key=repr) and not any(r[0] in range(130, 150) for r in kept) and len(kept) > 100
    assert as_rows(p.keep_quality(spark, extra, d)) == as_rows(one)
    unique = plain_near_duplicates(kept)
    two = p.one_of_each(spark, common.materialise(one, "t"), d)
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=repr) == sorted(((r[0], r[1]) for r in unique), key=repr) and len(unique) < len(kept) - 12
    p.BROADCAST_BYTES, was = -1, p.BROADCAST_BYTES  # the joins beyond a broadcast
    try:
        assert sorted(((r.doc_id, r.text) for r in p.one_of_each(spark, common.materialise(one, "t"), d).collect()), key=repr) == sorted(((r[0], r[1]) for r in unique), key=repr)
    finally:
        p.BROADCAST_BYTES = was
    clean = []
    for r in as_rows(two):
        text, last, out = r[1], 0, []
        for kind, a, b, _ in pii.find(text):
            out += [text[last:a], pii.render(kind, text[a:b], pii.surrogate(pii.KEY, kind, pii.canonical(kind, text[a:b])))]
            last = b
        clean.append((r[0], "".join([*out, text[last:]]), r[2], r[3]))
    three = p.surrogates(spark, common.materialise(two, "t"), d)
    assert as_rows(three) == sorted(clean, key=repr) and sum(a[1] != b[1] for a, b in zip(sorted(clean, key=repr), as_rows(two), strict=True)) > 5
    mixed = plain_mix(clean)
    four = p.mixture(spark, common.materialise(three, "t"), d)
    assert as_rows(four) == sorted(mixed, key=repr)
    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in mixed:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in p.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_probabilities_and_perplexities_against_dictionaries(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(3, 25), VOCABULARY), "xx") for i in range(40)] + [(40, "ba" * 400, "xx"), (41, "ü中", "xx"), (42, "", "xx"), (43, None, "xx"), (44, "ba", "none")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    trusted = set(range(30))
    learn = [t.encode() for i, t, lang in rows if i in trusted and spark_hash(i) % quality.FOLDS]
    plain = PlainKneserNey(learn)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    for most in (quality.MODEL_ROWS, 1):  # the broadcast model, and joins to the sharded one
        monkeypatch.setattr(quality, "TRUSTED_IDS", 1_000_000 if most > 1 else 0)
        got = {r.doc_id: r for r in quality.classify(df, ids, model_rows=most).collect()}
        for i, t, lang in rows:
            if lang == "xx" and t:
                assert math.isclose(got[i].perplexity, math.exp(plain.nll(t.encode()) / len(t.encode())), rel_tol=1e-9), i
        assert got[44].perplexity is None and got[44].keep and not got[42].keep and not got[43].keep
        assert {i for i in got if got[i].keep} == {r[0] for r in plain_quality(rows, trusted)}


def test_languages_against_plain_fusion(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    given += [(9000, None, None), (9001, "http://x.example.net/fr/1", ""), (9001, "http://x.example.net/fr/1", ""), (None, "http://hot.example.de/1", "<html lang='de'>" + "Das ist ein Satz und noch einer. " * 30_000)]
    given += [(10_000 + i, f"http://hot.example.de/{i}", "<html lang=de>kurz") for i in range(40)]
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    langs, table = language.text_models(docs)
    n, table = len(langs), table.astype(np.float32)
    hosts = [r.h for r in spark.createDataFrame([(g[1],) for g in given], "u string").select(host_and_path(F.col("u"))[0].alias("h")).collect()]
    seen = []
    for (page, _, html), host in zip(given, hosts, strict=True):
        m = language.DECLARED.search(html or "")
        code = m[1].lower() if m else ""
        at = language.slots(language.visible(html))
        log = table[:, at].sum(1, dtype=np.float64) * min(1.0, language.TEMPER / max(1, len(at))) if len(at) > 2 else np.zeros(n)
        log -= log.max()
        log -= np.log(np.exp(log).sum())
        seen.append((page, host, code if not code or code in langs else "other", log))
    votes = lambda key: {k: sum(np.exp(s[3]) for s in seen if key(s) == k) for k in {key(s) for s in seen}}
    suffix, domain = lambda s: s[1].split(".")[-1], lambda s: ".".join(s[1].split(".")[-2:])
    total = sum(np.exp(s[3]) for s in seen)
    prior = (total + 1) / (total.sum() + n)
    of_domain = {k: (v + language.PULL * prior) / (v.sum() + language.PULL) for k, v in votes(domain).items()}
    of_host = votes(lambda s: s[1])

    def likely(key):
        v = votes(key)
        return {k: np.log((x + language.EVIDENCE / len(v)) / (total + language.EVIDENCE)) for k, x in v.items()}

    declared, ends = likely(lambda s: s[2]), likely(suffix)
    want = []
    for s in seen:
        own, v = np.exp(s[3]), of_host[s[1]]
        host = np.log((np.maximum(0, v - own) + language.PULL * of_domain[domain(s)]) / (v.sum() - 1 + language.PULL))
        log = s[3] + declared[s[2]] + ends[suffix(s)] + host
        p = np.exp(log - log.max())
        want.append((s[0], langs[int(np.argmax(log))], 1 / p.sum()))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0))
    for most in (language.BROADCAST_ROWS, 0):  # small tables of likelihoods broadcast, and joined
        monkeypatch.setattr(language, "BROADCAST_ROWS", most)
        got = sorted(((r.page_id, r.lang, r.probability) for r in language.identify(pages, docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert all(math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("most", [jaccard.BROADCAST_BYTES, -1])
def test_components_by_tuples_of_words(spark, most):
    rng = random.Random(8)
    texts = [t for _, t, _, _ in corpus(rng)] + ["A b C d", "a B c D", "a b c d e", "x", "Ä b c d e f", "ä b c d e f"]
    line = words(rng, 40, VOCABULARY)
    texts += [line + " " + words(rng, 4, VOCABULARY) for _ in range(60)]
    rows = [(None if i % 37 == 5 else 7 if i % 41 == 6 else i + 100, t) for i, t in enumerate(texts)]
    rows += [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, texts[1])]
    kind = classes_of([t for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, kind, strict=True):
        if c is not None and i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, len(plain_shingles(t)), i if c is None else least.get(c, i)) for (i, t), c in zip(rows, kind, strict=True)), key=repr)
    jaccard.BROADCAST_BYTES, was = most, jaccard.BROADCAST_BYTES
    try:
        got = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        jaccard.BROADCAST_BYTES = was
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage, with only its cache left, or without a library that it needs."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", f"{top}/loadloom", f"{top}/__spark_entry__.py", f"{top}/corpus_pipeline.py", "-t", str(copy.mkdir() or copy)], check=True)
    ask = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q) > 150, any(n.startswith('op1') for n in q), 'op5_curriculum_mix' in o)"
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout.split()
    assert run(ask) == ["True", "True", "True"]
    assert run("import sys; sys.modules['ahocorasick'] = None; " + ask) == ["True", "False", "False"]
    os.remove(copy / "corpus_pipeline.py")
    assert run(ask) == ["True", "False", "False"]
    for f in (copy / "loadloom" / "llm").glob("*.py"):
        os.remove(f)
    assert run(ask) == ["True", "False", "False"]
