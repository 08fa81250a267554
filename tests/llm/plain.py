"""Plain versions of operators, for comparison."""

import re


def cut_lines(rows, min_words=50):
    """``{(id, text): (text left, lines removed)}`` by looking at all runs of lines."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    seen, out = set(), {}
    for i, text in order:
        if (i, text) in out:
            continue
        parts = (text or "").split("\n")
        lines = [(k, t, len(re.findall("[^ \t\r]+", t))) for k, p in enumerate(parts) if (t := p.strip(" \t\r"))]
        gone, mine = set(), []
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b][2]
                if words >= min_words:
                    run = tuple(x[1] for x in lines[a : b + 1])
                    mine.append((a, run))
                    if run in seen or any(r == run for s, r in mine if s < a):
                        gone |= {x[0] for x in lines[a : b + 1]}
        seen |= {r for _, r in mine}
        left = "\n".join(p for k, p in enumerate(parts) if k not in gone)
        out[i, text] = (text, 0) if not gone else (left, len(gone))
    return out
