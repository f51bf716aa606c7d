"""Small sequential models of the rules, used to check the jobs on random input."""

from itertools import groupby


def fold(lines, key, render):
    """Runs of lines with equal non-None key, each rendered to a list of lines."""
    out, i = [], 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and key(lines[i]) is not None and key(lines[j]) == key(lines[i]):
            j += 1
        out += render(lines[i:j])
        i = j
    return out


def repeats(lines):
    return fold(lines, lambda x: x.rstrip("\n"),
                lambda r: [r[0].rstrip("\n") + f" (×{len(r)})\n"] if len(r) >= 3 else r)


def diff(lines):
    return fold(lines, lambda x: 1 if x[:1] in (" ", "\t") else None,
                lambda r: [r[0], f"  ... ({len(r) - 2} unchanged lines)\n", r[-1]] if len(r) > 3 else r)


def build(lines):
    p = "   Compiling "
    return fold(lines, lambda x: 1 if x.startswith(p) else None,
                lambda r: [f"{p}... ({len(r)} crates)\n"] if r[0].startswith(p) else r)


def package(lines):
    import re
    rx = re.compile(r"npm WARN|added \d|packages? are|found \d")
    return fold(lines, lambda x: 1 if rx.match(x) else None,
                lambda r: [f"[npm: {len(r)} info lines omitted]\n"] if rx.match(r[0]) else r)


MARKS = ("FAILED ", "ERROR ", "=====", "_____", "short test summary")


def test_run(lines):
    """Stretches between markers, each with the count of what it lost."""
    out, seen = [], False
    stretches = [(m, list(g)) for m, g in groupby(lines, lambda x: x.startswith(MARKS))]
    for at, (is_mark, rows) in enumerate(stretches):
        if is_mark:
            out += rows
            seen = True
            continue
        kept = [x for x in rows if not x.startswith("PASSED ") and (
            seen or x.strip().startswith("collected") or "passed" in x or "failed" in x
            or not x.strip() or x.startswith(("platform", "rootdir")))]
        out += kept
        lost = len(rows) - len(kept)
        if lost:
            out.append(f"[{lost} lines omitted]\n" if at == len(stretches) - 1 else f"[{lost} passed]\n")
    return out


FAMILY = {"diff": diff, "build": build, "package": package, "test": test_run}


def dedup(events, shrinks):
    """events: (kind, scope, fp) in order; returns is_ref per 'row' event."""
    stored, out = {}, []
    for kind, scope, fp in events:
        mine = stored.setdefault(scope, {})
        if kind == "compact":
            for k in mine:
                mine[k] = False
        elif kind == "resume":
            for k in mine:
                mine[k] = True
        else:
            hit = mine.get(fp, False)
            out.append(hit)
            if not hit and shrinks:
                if shrinks(fp):
                    mine[fp] = True
    return out
