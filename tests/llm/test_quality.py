"""Quality statistics against plain Python."""

import re
from collections import Counter

from logsense.llm import quality


def stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_statistics(spark):
    clean = "It was the best of times and " + " ".join(f"tale{k} of river{k} and" for k in range(20)) + "."
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x\n\nx\ny\nx \n", "é# *|日本 <b>", clean, clean + "\n" + clean, "one two " * 9000, " a b", "A B\r\nA B\r\n" + clean, clean.upper(), "# " * 60 + clean, "zzz " * 30 + clean]
    docs = spark.createDataFrame([(k, t, 3, [1]) for k, t in enumerate(texts)] + [(7, clean, 3, [1]), (None, clean, 3, [1])], "doc_id long, text string, n_words int, words array<int>")
    got = quality.quality(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = clean if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == stats(t), t
    kept = {r.doc_id: r.kept for r in got}
    assert kept[7] and not kept[12] and not kept[13] and not kept[0] and not kept[9]
    assert quality.quality(docs.limit(0)).count() == 0


def test_one_projection(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
