"""Boilerplate of several lines and boilerplate among copies."""

from rastertab.llm import line_templates as lt


def own(i, k):
    return f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'xyzuv'[k]} opens its own line of some text here"


def test_passages_and_edge_lines_go(spark):
    passage = "all rights are with the press\nno part may be sold again\nwrite to us for a licence"
    rows = [(i, f"{own(i, 0)}\n{own(i, 1)}\n{passage}\n{own(i, 2)}\n{own(i, 3)}") for i in range(40)]
    rows += [(100 + i, f"first line of a header\nsecond line of a header\n{own(50 + i, 0)}\n{own(50 + i, 1)}\n{own(50 + i, 2)}") for i in range(9)]
    rows += [(200 + i, f"{own(70 + i, 0)}\n\nparagraph between two blank lines\n\n{own(70 + i, 1)}") for i in range(9)]
    for r in lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        lines = [x for x in r.text.split("\n") if x]
        assert len(lines) == (4 if r.doc_id < 100 else 3 if r.doc_id < 200 else 2)
        assert all("opens its own line" in x for x in lines)


def test_copies_neither_go_nor_shield_a_line(spark):
    notice = "printed by the old river press"
    rows = [(i, f"{own(i, 0)}\n{notice}\n{own(i, 1)}") for i in range(20)]
    copy = f"{own(30, 0)}\n{notice}\n{own(30, 1)}"
    rows += [(100 + i, copy) for i in range(60)]
    base = [own(40 + i, 0) for i in range(12)]
    near = {}
    for i in range(300):
        lines = [own(60 + i, 4) if j == i % 12 else x for j, x in enumerate(base)]
        near[1000 + i] = "\n".join(lines)
    rows += list(near.items())
    for r in lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert notice not in r.text
        assert len(r.text.split("\n")) == (12 if r.doc_id >= 1000 else 2)
        assert r.text == near.get(r.doc_id, r.text)


def test_short_near_copies_with_changed_heads_stay(spark):
    """Copies of two long lines, a third of them with another word in one head."""
    words = [[f"{c}{k}word" for k in "abcdefghijklmnop"] for c in "xy"]
    rows = []
    for i in range(90):
        lines = [list(x) for x in words]
        lines[i % 2][i // 3 % 3 if i % 3 == 0 else 5 + i % 7] = own(i, 0).split()[0]
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    out = lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
