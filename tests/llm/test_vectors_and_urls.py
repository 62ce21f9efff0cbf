"""Embedding near-dedup and URL rules against brute force."""

import math
import tempfile

import numpy as np
import pytest

from ionframe.llm import embedding_dedup as E
from ionframe.llm import url_filter as U

NAN = float("nan")


def brute(rows, threshold=0.95):
    ok = {n: np.array(v, dtype=float) for n, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {n: [] for n in range(len(rows))}
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].append(b)
    least = {n: rows[n][0] for n in links}
    for _ in rows:
        for a, bs in links.items():
            for b in bs:
                least[a] = min(least[a], least[b])
    return sorted((rows[n][0], len(links[n]), least[n], rows[n][0] == least[n]) for n in links)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(25):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(size=16) * s]) for k, s in enumerate((0.0, 0.2, 0.3, 0.45))]
    same = rows[3][1]
    rows += [(200, same), (201, same), (201, same), (202, None), (203, [0.0] * 16), (204, [NAN] + [1.0] * 15), (205, [float("inf")] + [1.0] * 15), (206, [None] + [1.0] * 15), (207, []), (208, [1.0, 0.0]), (209, [2.0, -0.0]), (210, [x * 3 for x in same]), (211, [1e-30] * 16)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, links string, key int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(frame).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found == brute(rows)
    assert E.near_duplicates(frame.limit(0)).count() == 0


def test_many_tiles_and_repeated_ids(spark):
    """Cut into tiles of 16, in several groups: chains of near copies over tiles, vectors of two lengths, one id for unlike
    vectors, rows without an id, squares that under- and overflow."""
    rng = np.random.default_rng(11)
    rows = []
    for size in (8, 12):
        for _ in range(12):
            base = rng.normal(size=size)
            base /= np.linalg.norm(base)
            for _ in range(int(rng.integers(2, 40))):
                rows.append((len(rows), [float(x) for x in base + rng.normal(size=size) * 0.08]))
    rows += [(1, rows[300][1]), (1, rows[0][1]), (1, [float(x) for x in rng.normal(size=8)]), (None, rows[40][1]), (None, [float(x) for x in rng.normal(size=12)])]
    rows += [(2000, [1e-200, 0.0]), (2001, [1e200, 0.0]), (2002, [5e-324, 0.0]), (2003, [1.7e308, 1e307]), (2004, [0.0, -1e-310])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(frame, tile=16).collect()), key=str)
    scaled = [(i, list(np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])))) for i, v in rows]
    least = lambda a, b: a if b is None else b if a is None else min(a, b)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in scaled]
    links = {a: [b for b in range(len(rows)) if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95] for a in range(len(rows))}
    root = {a: rows[a][0] for a in links}
    for _ in range(40):
        for a, bs in links.items():
            for b in bs:
                root[a] = least(root[a], root[b])
    assert found == sorted(((rows[a][0], len(links[a]), root[a], rows[a][0] == root[a]) for a in links), key=str)
    assert sum(map(len, links.values())) > 5000


@pytest.mark.parametrize("size", [3, 1040, 1041, 2500])
def test_bounds_hold_in_any_dimension(size):
    rng = np.random.default_rng(size)
    x = E.unit(rng.choice([-1.0, 1.0], (40, size)) * (1 + 1e-3 * rng.random((40, size))))  # the largest products there are
    y = np.concatenate([x[:20], E.unit(x[20:] + rng.normal(size=(20, size)) * 0.3)])
    qx, qy = E.quantised(x), E.quantised(y)
    assert (E.products(qx[0], qy[0]) == qx[0].astype(np.int64) @ qy[0].astype(np.int64).T).all()
    for threshold in (0.5, 0.95):
        found = {(int(i), int(j)) for p, q in E.linked_pairs(x, y, qx, qy, threshold) for i, j in zip(p, q, strict=True)}
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ y.T >= threshold), strict=True)}


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    x, y = E.unit(rng.normal(size=(300, 24))), E.unit(rng.normal(size=(200, 24)))
    y[:100] = E.unit(x[:100] + rng.normal(size=(100, 24)) * 0.07)
    found = {(i, j) for p, q in E.linked_pairs(x, y, E.quantised(x), E.quantised(y), 0.9) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ y.T >= 0.9), strict=True)}
    q, s, _, e = E.quantised(x)
    assert (np.linalg.norm(x - q * s[:, None], axis=1) <= e).all()


URLS = ["http://org/", "https://A.B.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "http://example.com/fr", "http://example.com/fr/1", "http://m.example.com/de/?q", "ftp://com", "no scheme", "", None, "http://", "http://example.org?x=/es/", "a://b://c.org/d", "http://exämple.org/", "http://org:80/", "http://a.org/\n/es/"]


def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_rules(spark):
    rules = [*U.RULES, U.Rule("b.example.org", "/es/x", "allow"), U.Rule("exämple.org", "/", "block")]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, host string")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(frame, rules).collect()}
    assert found == {(i, *brute_url(u, rules)) for i, u in enumerate(URLS)}
    assert U.filter_urls(frame.limit(0)).count() == 0


def test_collisions_never_decide(monkeypatch):
    monkeypatch.setattr(U, "digest", lambda text: len(text) % 3)
    prefix = f"{tempfile.mkdtemp()}/rules-"
    assert U.build_index(U.RULES, prefix) > 0
    index = U.DigestArray(prefix)
    for url in URLS:
        host, path, rule, verdict = brute_url(url, U.RULES)
        got = index.judge([host], [path])[0]
        assert (got[0], got[1] or "allow") == (rule, verdict)
