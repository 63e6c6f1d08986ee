"""The operator against a plain reading of its rules, text by text and window by window."""

import random
import re

from splitwarden.llm import templates

UNITS, OPENERS, NUMBERS = (set(x.split()) for x in (templates.UNITS, templates.OPENERS, templates.NUMBERS))
TOKEN = re.compile("[A-Za-z\x80-\U0010ffff]+|[0-9]+")


def fold(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def forms(text):
    """Three lists of (token, value or None): plain, and two with placeholders."""
    found = list(TOKEN.finditer(text or ""))
    words = [fold(m.group()) for m in found]
    out = [[(w, None) for w in words]]
    for second in (False, True):
        form = []
        for i, m in enumerate(found):
            raw, word, gap = m.group(), words[i], text[found[i - 1].end() : m.start()] if i else ""
            digits = raw[0].isascii() and raw[0].isdigit()
            after_digits = i > 0 and words[i - 1][0] in "0123456789"
            opens = i == 0 or any(c in '.!?:;\n"' for c in gap)
            capital = len(raw) > 1 and "A" <= raw[0] <= "Z"
            beyond = len(raw) > 1 and not raw[0].isascii() and (raw[0].isupper() or raw[0].istitle())
            name = ((capital and not "A" <= raw[1] <= "Z") or beyond) and not opens
            if second:
                name = name or ((capital or beyond) and word not in OPENERS)
            if digits or (second and word in NUMBERS):
                if digits and after_digits and gap in (".", ",") and form[-1][0] == "<number>":
                    form[-1] = ("<number>", form[-1][1] + (word,))
                else:
                    form.append(("<number>", (word,)))
            elif after_digits and word in UNITS:
                form.append(("<unit>", (word,)))
            elif name and form and form[-1][0] == "<name>" and not opens:
                form[-1] = ("<name>", form[-1][1] + (word,))
            else:
                form.append(("<name>", (word,)) if name else (word, None))
        out.append(form)
    return out


def brute(docs, items, width=13, shortest=6):
    best = {}
    parsed = [(i, forms(t)) for i, t in items]
    lengths = {len(f) for _, fs in parsed for f in fs if shortest <= len(f) < width} | {width}
    for doc_id, text in docs:
        for which, form in enumerate(forms(text)):
            for item_id in {i for i, _ in items}:
                aligned = {}
                for fs in (fs for i, fs in parsed if i == item_id):
                    ours = fs[which]
                    for w in lengths:
                        for pos in range(len(ours) - w + 1) if w == width or len(ours) == w else ():
                            part = ours[pos : pos + w]
                            slots = [p for p, (_, v) in enumerate(part) if v is not None]
                            if which and not 0 < len(slots) < w:
                                continue
                            for at in range(len(form) - w + 1):
                                theirs = form[at : at + w]
                                if [x for x, _ in part] == [x for x, _ in theirs]:
                                    aligned.setdefault(at - pos, []).append((pos, slots, [part[p][1] for p in slots], [theirs[p][1] for p in slots]))
                for windows in aligned.values():
                    n = counted(windows, width)
                    if n:
                        best[(doc_id, item_id)] = max(n, best.get((doc_id, item_id), 0))
    return best


def counted(windows, width):
    means = {}
    odd, at = set(), {}
    for pos, slots, ours, theirs in windows:
        at.setdefault(pos, set()).update(pos + p for p in slots)
        means = {a: {y for x, y in zip(ours, theirs, strict=True) if x == a} for a in ours}
        odd |= {pos + p for p, a in zip(slots, ours, strict=True) if len(means[a]) > 1}
    good = {pos for pos, places in at.items() if not places & odd}
    if odd:
        order = sorted(at)
        runs, run = [], [order[0]]
        for pos in order[1:]:
            if pos == run[-1] + 1:
                run.append(pos)
            else:
                runs.append(run)
                run = [pos]
        for run in [*runs, run]:
            span = set(range(run[0], run[-1] + width))
            if len(run) > 1 and len(span - set().union(*at.values())) >= 2 * width:
                good |= set(run)
    return len(good)


def texts(seed):
    rnd = random.Random(seed)
    plain = "the of boxes birds red old trains meet how many are left then each buys sells under green hills and walks".split()
    names = ["Tom", "Ann", "Émile", "Örjan", "NASA", "Lee Ann", "McKay"]

    def word():
        return rnd.choices([rnd.choice(plain), rnd.choice(names), str(rnd.randint(1, 30)), f"{rnd.randint(1, 9)}.{rnd.randint(1, 9)}", rnd.choice(["two", "seven", "dozen"]), f"{rnd.randint(2, 40)} km"], [8, 1.5, 1.5, 0.4, 0.6, 0.6])[0]

    def sentence(n):
        return " ".join(word() for _ in range(n)) + rnd.choice([".", "?", "!", ""])

    def changed(text):
        swap = {}
        def other(m):  # noqa: E306
            if rnd.random() < 0.03:
                return rnd.choice(names + ["17", "red"])
            kind = names if m.group() in names else [str(i) for i in range(40, 70)] if m.group().isdigit() else None
            return swap.setdefault(m.group(), rnd.choice(kind)) if kind else m.group()

        return re.sub(r"\w+", other, text)

    items = [(i, " ".join(sentence(rnd.randint(3, 14)) for _ in range(rnd.randint(1, 3)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "a b c"), (3, items[3][1]), (4, sentence(9)), (None, sentence(16))]
    docs = []
    for i in range(70):
        item = rnd.choice(items)[1] or ""
        docs.append((i % 64, " ".join([sentence(rnd.randint(0, 12)), changed(item) if rnd.random() < 0.7 else item, sentence(rnd.randint(0, 12))])))
    return docs + [(None, items[5][1]), (200, None), (201, ""), (202, "x " * 4000 + items[6][1])], items


def test_against_plain_reading(spark):
    for seed in (1, 2, 3):
        docs, items = texts(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
        got = {(r.doc_id, r.item_id): r.n_windows for r in templates.contaminated(d, b).collect()}
        assert got == brute(docs, items) and len(got) > 20
        clean = {x for x, _ in docs if not any(k[0] == x for k in got)}
        assert {r.doc_id for r in templates.without_contaminated(d, b).collect()} >= clean
