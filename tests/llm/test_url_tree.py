"""The path-template tree against one that is grown with dictionaries, on random urls and labels."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from tidewright.llm import url_templates as U


def grown(urls):
    """Template of every url: level by level, positions of many values that hardly repeat become wildcards."""
    rows = []
    for u in urls:
        m = re.match(r"^.*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rows.append([host, [("*" if re.search("[0-9]", s) else s) for s in path.split("/") if s]])
    prefix = [r[0] for r in rows]
    for level in range(max((len(r[1]) for r in rows), default=0)):
        seen = defaultdict(lambda: defaultdict(int))
        for p, (_, s) in zip(prefix, rows):
            if len(s) > level:
                seen[p][s[level]] += 1
        wild = {p for p, v in seen.items() if len(v) > U.FEW_VALUES and sum(v.values()) < U.REPEAT * len(v)}
        prefix = [p if len(s) <= level else f"{p}/*" if p in wild else f"{p}/{s[level]}" for p, (_, s) in zip(prefix, rows)]
    return prefix


def judged(templates, bad):
    """Templates that are rejected: branches merge into their parent from the leaves up, unless they differ from the rest of their siblings."""
    n, k = defaultdict(int), defaultdict(int)
    for t, b in zip(templates, bad):
        n[t] += b is not None
        k[t] += bool(b)
    rate = sum(k.values()) / max(sum(n.values()), 1)
    leaves, alone = set(templates), {}
    share = {}
    nodes = set(templates)
    for d in range(max((t.count("/") for t in templates), default=0), -1, -1):
        here = {t for t in nodes if t.count("/") == d}
        above = lambda t: t.rsplit("/", 1)[0]
        pools = defaultdict(lambda: [0, 0])
        for t in here:
            share[t] = (k[t] + U.PRIOR * rate) / (n[t] + U.PRIOR) >= U.PURITY
            pools[above(t)][0] += n[t]
            pools[above(t)][1] += k[t]
        for t in here:
            rest = pools[above(t)][0] - n[t] + U.PRIOR
            p = (pools[above(t)][1] - k[t] + U.PRIOR * rate) / rest
            gap = abs(k[t] - n[t] * p)
            alone[t] = d == 0 or gap > U.Z_MERGE * math.sqrt(max(n[t] * p * (1 - p) * (1 + n[t] / rest), 0.25))
        if d:
            for t in here:
                if not alone[t]:
                    nodes.add(above(t))
                    n[above(t)] += n[t]
                    k[above(t)] += k[t]

    def verdict(t):
        return share[t] if alone[t] else verdict(t.rsplit("/", 1)[0])

    return {t for t in leaves if verdict(t)}


def urls(rng):
    out = []
    for _ in range(rng.randint(200, 500)):
        parts = []
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 6])):
            parts.append(rng.choice([rng.choice("abc"), f"item{rng.randrange(99)}", "".join(rng.choice("xyzw") for _ in range(rng.randint(1, 5)))]))
        out.append(f"http://{rng.choice(['one.io', 'two.io', 'Sub.two.io'])}/{'/'.join(parts)}{rng.choice(['', '/', '?q=1'])}")
    return out + rng.sample(out, 30) + [None, "no scheme", "http://one.io", "http://one.io//a//b"]


def test_templates_and_verdicts_match_a_plain_tree(spark):
    rejected = 0
    for seed in range(4):
        rng = random.Random(seed)
        made = urls(rng)
        worse = {rng.choice("abc"), "one.io"}
        marks = [None if rng.random() < 0.3 else rng.random() < (0.9 if any(w in (u or "") for w in worse) else 0.1) for u in made]
        pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(made)], "page_id long, url string, template string, n int")
        labels = spark.createDataFrame([(i, b) for i, b in enumerate(marks) if b is not None], "page_id long, bad boolean")
        got = {r["page_id"]: r for r in U.filter_urls(pages, labels, rules=()).collect()}
        templates = grown(made)
        assert [got[i]["template"] for i in range(len(made))] == templates
        bad = judged(templates, marks)
        rejected += len(bad)
        assert {i for i in got if got[i]["verdict"] == "block"} == {i for i, t in enumerate(templates) if t in bad}
    assert rejected > 20
