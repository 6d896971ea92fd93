"""Quality rules against plain counting, with nulls, ties, repeats and empty tables."""

import re
from collections import Counter, defaultdict

from sitegrid.llm import quality

from .cases import awkward, frame


def counts(text):
    t = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
    lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    tri = Counter(zip(words, words[1:], words[2:]))
    covered = {i + o for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for o in (0, 1, 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)


def verdicts(rows):
    marked = []
    for r in rows:
        n, chars, symbols, dup, repeat, lines = counts(r[1])
        marked.append((r, (n, chars, symbols, dup, repeat), n < 50 or 100 * repeat > 50 * n,
                       {"symbols": 10 * symbols > n, "dup_lines": 10 * dup > 3 * lines, "word_length": chars < 3 * n or chars > 10 * n}))
    bad = set()
    for rule in ("symbols", "dup_lines", "word_length"):
        hosts = defaultdict(lambda: [0, 0])
        for r, _, _, flags in marked:
            hosts[r[3]][0] += 1
            hosts[r[3]][1] += flags[rule]
        n, k = sum(h[0] for h in hosts.values()), sum(h[1] for h in hosts.values())
        p, within = k / n, len(hosts) - 1
        spread = sum(h[1] ** 2 / h[0] for h in hosts.values())
        below = n - sum(h[0] ** 2 for h in hosts.values()) / n - within
        share = ((spread - k * p) / (p * (1 - p)) - within) / below if p * (1 - p) and below else 0
        share = min(max(share, 1e-6), 1 - 1e-6)
        bad |= {(host, rule) for host, (m, f) in hosts.items() if (f + p * (1 / share - 1)) / (m + 1 / share - 1) > 0.5}
    return [(r, c, base, not (base or any(f and (r[3], rule) in bad for rule, f in flags.items()))) for r, c, base, flags in marked]


def test_counts_and_host_verdicts(spark):
    rows = awkward()
    body = " ".join(f"plain{i}" for i in range(60))
    rows += [(600 + i, body + " #" * (9 if i % 5 else 0), "en", "bad host", 1, "x", "y") for i in range(40)]
    rows += [(700 + i, body + (" #" * 9 if i == 0 else ""), "en", "good host", 1, "x", "y") for i in range(40)]
    rows += [(800 + i, "\n".join([body] + ["again and again"] * (i % 3) * 2), "en", None, 1, "x", "y") for i in range(9)]
    got = quality.judge(frame(spark, rows)).collect()
    key = lambda r: repr(r[0])
    have = sorted(((tuple(r.row), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) for r in got), key=key)
    want = sorted(verdicts(rows), key=key)
    assert have == want
    kept = {r[0]: k for r, _, _, k in want}
    assert not kept[601] and kept[600] and kept[700]
    assert quality.judge(frame(spark, [])).count() == 0
