from veridock.sources import formats


def test_references_without_semicolon():
    """HTML resolves the old references without their semicolon, as before a tag."""
    assert formats.from_html("<h1>a &amp;&amp</h1><p>b &amp; c</p>") == "a &&\nb & c"
