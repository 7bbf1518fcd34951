from cardmill.llm import scan_noise as S

COUNTS = {w: n for n, ws in {500: "the of a and in is", 60: "charter market guides vessel valve matrix lattice kinship membrane reduces density colony self regulation self-regulation well known well-known sample rises"}.items() for w in ws.split()}


def kinds(text, topic=""):
    return {(line, kind) for line, kind, _, _ in S.Page(text, S.Lexicon(COUNTS), topic).findings() if kind != "header"}


def test_hyphens_and_compounds():
    assert kinds("the mar-\nket rises") == {(1, "hyphen")}
    assert kinds("the mar¬\n\nket rises") == {(1, "hyphen")}
    assert kinds("a well-\nknown sample") == set()
    assert kinds("a self-\nregulation valve") == set()
    assert kinds("the sample -\nthe valve") == set()


def test_misread_words():
    for bad in ("chartér", "markef", "guidcs", "ve5sel", "va|ve", "mafrix", "lattlce", "kiriship", "rnembrane", "recluces", "dens!ty", "(olony"):
        assert kinds(f"a sample and {bad} in the valve") == {(1, "misread")}, bad
    assert kinds("the (colony + 37) of a zurbanol and B12") == set()
    assert kinds("the mem-\nbrarie rises and") == {(1, "hyphen"), (2, "misread")}
    assert kinds("the rnem-\nbrane rises and") == {(1, "hyphen"), (1, "misread")}


def test_page_numbers():
    for line in ("12", "[7]", "- 31 -", "Page 8", "p. 3 of 40", "xiv", "Page l29", "[l9]"):
        assert kinds(f"the valve rises.\nthe sample\nof a colony.\n{line}") == {(4, "page_number")}, line
    assert kinds("the valve rises.\nthe sample\nof a colony\n38)") == set()


def read(lexicon, stream):
    return [w.word or stream[w.start : w.end] for w in lexicon.decode(stream)[1]]


def test_decoding_splits_and_merges():
    lexicon = S.Lexicon(COUNTS)
    assert read(lexicon, "themarket") == ["the", "market"]
    assert read(lexicon, "mar ket") == ["market"]
    assert read(lexicon, "mar-\nkef") == ["market"]
    assert read(lexicon, "mar\nket") == ["market"]
    assert read(lexicon, "thcmar kef") == ["the", "market"]
    assert read(lexicon, "self-\nregulation") == ["self-regulation"]
    assert read(lexicon, "zurbanol") == ["zurbanol"]
    for word in lexicon.decode("the mar-\nkef")[1][1:]:
        assert (word.word, word.edits, word.wrong, word.hyphen) == ("market", 1, 11, 7)


def test_pages_are_decoded_over_blanks_and_line_ends():
    counts = {w: n for n, ws in {500: "the of a and in is", 60: "inflammation heart muscle market guides"}.items() for w in ws.split()}
    page = S.Page("the inflam mation of theheart is\nmuscle", S.Lexicon(counts))
    assert page.paragraphs(set()) == ["the inflammation of the heart is muscle"]
    page = S.Page("The INFLAM-\nMATION of \"tlieheart\", the mar ket gui-\ndcs the musc1e.", S.Lexicon(counts))
    assert page.paragraphs(set()) == ['The INFLAMMATION of "the heart", the market guides the muscle.']
    assert {(n, k) for n, k, _, _ in page.findings() if k != "header"} == {(1, "hyphen"), (2, "misread"), (2, "hyphen"), (3, "misread")}


def test_long_unknown_forms_stay():
    lexicon = S.Lexicon(COUNTS)
    for long in ("日本語" * 30, "http://example0rg/" + "abc1" * 20, "donaudampfschifffahrtsgesellschaftskapitänsmütze"):
        assert read(lexicon, long) == [long]
        assert S.Page(f"the {long} rises", lexicon).paragraphs(set()) == [f"the {long} rises"]


def test_rare_clean_words_are_kept_at_any_size(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitänsmütze"
    rows = [("n", 0, f"zurbanol and {long} twice", "s/n.md")] + [("m", k, "the market rises " * 20_000, "s/m.md") for k in range(17)]
    rows += [("p", 0, "market porvane porvane porvane marquith\nmarkef markef markef", "s/p.pdf p.1")]
    counts = S.lexicon_counts(spark.createDataFrame(rows, "doc_id string, chunk_pos int, text string, source string"))
    assert counts == {"zurbanol": 1, "and": 1, long: 1, "twice": 1, "the": 340_000, "market": 340_001, "rises": 340_000, "porvane": 3}


def test_documents(spark):
    body = "the market guides a vessel and the valve\nreduces the density of a col-\nony in the lattice."
    rows = [("d", k, f"Lamp Repair: Of valves\n{body}\n{k + 1}", f"s/lamp-repair-x-1.pdf p.{k + 1}") for k in range(3)]
    rows += [("d", 3, f"Once Only Title\n{body}", "s/lamp-repair-x-1.pdf p.4 (OCR)"), ("n", 0, body.replace("-\n", ""), "s/n.md"), ("e", 0, None, "s/e.pdf p.1"), ("f", 0, "", "s/f.pdf p.1"), ("g", 0, body, None)]
    data = spark.createDataFrame([(*r, "clash") for r in rows + rows], "doc_id string, chunk_pos int, text string, source string, kind string")
    found = {(r.doc_id, r.chunk_pos, r.line_no, r.kind) for r in S.settled(S.scan_findings(data)).collect()}
    assert found == {("d", k, n, kind) for k in range(3) for n, kind in ((1, "header"), (3, "hyphen"), (5, "page_number"))} | {("d", 3, 3, "hyphen")}
    texts = {(r.doc_id, r.chunk_pos): r.text for r in S.repaired(data).collect()}
    assert texts[("d", 0)] == "the market guides a vessel and the valve reduces the density of a colony in the lattice."
    empty = data.limit(0)
    assert S.settled(S.scan_findings(empty)).count() == 0 and S.repaired(empty).count() == 0


def test_paragraphs_follow_blanks_and_flow():
    page = S.Page("the market rises.\n\nthe valve and\nthe colony\nguides a sample.", S.Lexicon(COUNTS))
    assert page.paragraphs(set()) == ["the market rises.", "the valve and the colony guides a sample."]
