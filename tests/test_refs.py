from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.operators import refs as R


def targets(text):
    return [(r[0], r[1]) for r in R.parse(text)]


def test_grammar():
    assert targets("See [[Some Page|shown]] and [[ Other ]].") == [("some page", False), ("other", False)]
    assert targets("#Tag x#no #año #c+ #1no #a-b~c'd^e (#no)") == [("tag", True), ("año", True), ("c", True), ("a-b~c'd^e", True)]
    assert targets("`#code [[no]]` #yes `unclosed #too") == [("yes", True), ("too", True)]
    assert targets("```\n#in\n```\n#out\n```\n[[rest]]") == [("out", True)]
    assert targets("~~~\n#live\n  ```\n#live2") == [("live", True), ("live2", True)]
    assert targets("[[T|]] [[T|   ]] [[ ]]") == [("t", False), ("t", False), ("", False)]


def test_heading_and_context():
    rows = R.parse("# Top #tag\ntext " + "x" * 80 + " [[Ref]] tail\n## Next\n#more")
    assert [(r[0], r[2]) for r in rows] == [("tag", "Top #tag"), ("ref", "Top #tag"), ("more", "Next")]
    assert rows[1][3] == "x" * 59 and rows[1][4] == "[[Ref]]" and rows[1][5] == "tail"


def test_wikilinks_come_before_hashtags_of_a_line():
    assert targets("#a [[b]] #c") == [("b", False), ("a", True), ("c", True)]


def test_frontmatter():
    assert targets('---\ntitle: x\nlinked: ["A B", C]\n---\n#t') == [("a b", False), ("c", False), ("t", True)]
    assert targets("---\nlinked: [\n---\n#t") == [("t", True)]
    # A block like frontmatter in the middle is not indexed, but is rewritten.
    middle = "#a\n---\n#b\n---\n#c\n"
    assert targets(middle) == [("a", True), ("c", True)]
    assert R.rewrite(middle, "b", lambda s: "#z")[1] == 1
    assert R.linked_titles("---\nlinked: abc\n---\n") == ["a", "b", "c"]


def test_blanked_code_keeps_its_width():
    assert targets("`x`#live [[a`b`c]]") == [("a   c", False), ("live", True)]


def test_rewrite():
    text = "---\nt: '#py'\n---\n# Head #Py\r\n#PY, `#py` #python #py\n```\n#py\n```\nend #py"
    out, n = R.rewrite(text, "py", lambda s: f"`{s}`")
    assert n == 4 and out == "---\nt: '#py'\n---\n# Head `#Py`\r\n`#PY`, `#py` #python `#py`\n```\n#py\n```\nend `#py`"
    assert R.rewrite("nothing", "py", str) == ("nothing", 0)


def test_links_in_frontmatter():
    text = "---\ntitle: x\n---\nbody"
    more = R.set_linked(R.set_linked(text, add="A"), add="B")
    assert R.linked_titles(more) == ["A", "B"] and R.set_linked(more, add="A") == more
    less = R.set_linked(R.set_linked(more, remove="A"), remove="B")
    assert R.linked_titles(less) == [] and "linked" not in less and less.endswith("---\nbody")
    assert R.set_linked("no head", add="A") == "no head"


TEXT = st.text(st.sampled_from("#ab `\n[]|-~é\r"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_rewritten_tags_have_the_new_name(text):
    keys = {r[0] for r in R.parse(text) if r[1]}
    for key in keys:
        out, n = R.rewrite(text, key, lambda s: "#zz")
        left = [r[0] for r in R.parse(out) if r[1]]
        assert n == 0 or ("zz" in left or not R.FRONTMATTER.match(text) is None)
        silent, n = R.rewrite(text, key, lambda s: f"`{s}`")
        if "`" not in text and "---" not in text:
            assert key not in [r[0] for r in R.parse(silent) if r[1]]
