"""Checksums, features, weights and ranks against plain Python; licenses against edit distances of all places."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clipfleet.llm import importance_resampling as I
from clipfleet.llm import license_scan as L

SCHEMA = "doc_id long, text string, n_words long, score string, rank string, places string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = ["", None, "  \n", "One TWO one", "é ñ Ünï x9", "a" * 700 + " b", "long words " * 20000, "\x00\x1f[]{}", "日本 語x"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("reach", [1, 5, 64])
def test_span_checksums(reach):
    rng = random.Random(reach)
    data = np.frombuffer(rng.randbytes(6000), dtype=np.uint8)
    starts = np.array([rng.randrange(4000) for _ in range(500)])
    sizes = np.array([rng.choice([1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1999]) for _ in range(500)])
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]
    crc = I.SpanCrc(reach)
    assert crc(data, starts, sizes).tolist() == want
    assert crc(data, starts[:0], sizes[:0]).tolist() == []


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
@pytest.mark.parametrize("most", [1, 3])
def test_features_match_plain_hashing(most, size):
    rng = random.Random(most)
    texts = [x or "" for x in EDGE[:6] + EDGE[7:]] + ["".join(rng.choice(["a", "B", " ", "é", "-", "9", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for array in (pa.array(texts), pa.array(["cut", *texts, "off"]).slice(1, len(texts))):
        got, n = [Counter() for _ in texts], Counter()
        for row, bucket, word in I.features(array, I.SpanCrc(7), most, 97, size):
            n.update(word.tolist())
            for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
                got[r][b] += 1
        for text, found, count in zip(texts, got, (n[k] for k in range(len(texts))), strict=True):
            w = words(text)
            assert count == len(w)
            assert found == Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in range(1, most + 1) for i in range(len(w) - k + 1))


def test_resample_matches_brute_force(spark):
    rng = random.Random(3)
    pool = ["alpha", "Beta", "gamma", "délta", "e5", "zeta", "eta"]
    rows = [(k, " ".join(rng.choices(pool, weights=[9, 5, 3, 2, 1, 1, 1], k=rng.choice([0, 3, 19, 20, 21, 60])))) for k in range(400)]
    rows += [(1000 + k, x) for k, x in enumerate(EDGE)] + [(None, "no id " * 15), (5, "twice " * 25), (5, "twice " * 25)]
    target = [(k, " ".join(rng.choices(["zeta", "eta", "theta"], k=30))) for k in range(20)] + [(99, None)]
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(zlib.crc32(w.encode()) % 10000 for w in words(x))
    for _, x in target:
        t.update(zlib.crc32(w.encode()) % 10000 for w in words(x))
    S, T = sum(s.values()), sum(t.values())
    want = []
    for d, x in rows:
        w = words(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in (zlib.crc32(v.encode()) % 10000 for v in w))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((*r, k) for k, r in enumerate(fit[: len(fit) * 10 // 100], 1))
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in I.resample(docs(spark, rows).repartition(7), docs(spark, target)).collect())
    assert Counter({k[:4]: 0 for k in got}).keys() == set(want) and sum(got.values()) == len(rows)
    assert Counter({k: v for k, v in got.items() if k[4]}) == drawn


def test_resample_of_nothing(spark):
    assert I.resample(docs(spark, []), docs(spark, [])).count() == 0
    assert [r["rank"] for r in I.resample(docs(spark, [(k, "word " * 30) for k in range(10)]), docs(spark, [])).collect()].count(1) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(text, notice):
    """Whether some run of words is within the notice's edits, by the distance of all of them."""
    w = words(text)
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            part = " ".join(w[i:j])
            if abs(len(part) - len(notice.text)) <= notice.edits and distance(part, notice.text) <= notice.edits:
                return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_no_notice_within_its_edits_is_missed(seed):
    rng = random.Random(seed)
    for _ in range(150):
        notice = rng.choice(L.NOTICES)
        body = list(notice.text)
        for _ in range(rng.randint(0, notice.edits + 2)):
            at = rng.randrange(len(body))
            kind = rng.random()
            if kind < 0.4:
                body[at] = rng.choice("abxyz ")
            elif kind < 0.7 and len(body) > 1:
                del body[at]
            else:
                body.insert(at, rng.choice("abxyz "))
        text = " ".join(rng.choices(["some", "mit", "license", "the", "public", "gnu"], k=3)) + " " + "".join(body).title() + " " + " ".join(rng.choices(["under", "terms", "copy", "x"], k=3))
        found = L.fuzzy_places(L.words_of(text))
        for i, n in enumerate(L.NOTICES):
            assert any(f[0] == i for f in found) == near(text, n), (text, n)
        for i, a, b, edits in found:
            assert distance(L.words_of(text)[a:b], L.NOTICES[i].text) == edits <= L.NOTICES[i].edits


def test_licenses_of_rows(spark):
    rows = [(k, x) for k, x in enumerate(EDGE)]
    rows += [(20, "Under the MIT License; mit license. CC-BY 4.0"), (21, "GNU Genral Public Licence v3"), (22, "submit license and cc byte"), (22, "submit license and cc byte"), (None, "Apache\nLicense"), (24, "Mozila Public License, gnu general public license")]
    got = [r for r in L.find_licenses(docs(spark, rows)).collect()]
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[k].labels == "" and by[k].score == 0 and by[k].n_words == len(words(x)) for k, x in enumerate(EDGE))
    assert [(p.word, p.label) for p in by[20].places] == [(2, "mit"), (4, "mit"), (6, "cc-by")] and by[20].labels == "cc-by,mit" and by[20].score == 1
    assert by[21].base_labels == "" and by[21].labels == "gpl" and 0.9 < by[21].score < 1 and tuple(by[21].spans[0])[:4] == ("gpl", 0, 3, 2)
    assert by[22].labels == "" and by[None].labels == "apache"
    assert by[24].base_labels == "gpl" and by[24].labels == "gpl,mpl"
    assert L.find_licenses(docs(spark, [])).count() == 0
