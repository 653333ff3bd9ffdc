from __future__ import annotations

import numpy as np
import pytest

from rangeloom.llm import residue as R

PROSE = [
    "As shown in FIG. 10, the gas inlet 277 engages the flexible routing table 286 along an arc of 32 degrees.",
    "It has been found that only a few parts are needed if the control unit has a thickness between 10 and 378 mm.",
    "Known arrangements use a lower spring washer, which has the drawback that the filter cartridge ages quickly.",
    "Messungen bei 26 °C ergaben für Wärmetauscher Werte von 49 kPa.",
    "L'épaisseur de échangeur de chaleur est de préférence comprise entre 23 et 408 mm.",
    "Las mediciones a 32 °C dieron 403 kPa para brazo de agarre.",
    "在34摄氏度下测得载体膜的数值为73千帕。",
    "[Formula 32]  (26)", "##EQU00013##  (29)", "$\\mu_{8}$ = {{x}_{17}", "x = {a, b, {c}, 8}", '<img id="ib0015"/>', "(mathematical expression 8 omitted)", "H<2>SO<36> + 2 Na...", "R1-[CH2]n-R16 (I)",
    "1. A method of operating a gripper arm device, in which a sealing ring is biased.", "The valve seat assembly of claim 9, wherein the needle bed is a movable mould half.",
]
HEADS = ["Abstract", "ABSTRACT", "Summary", "DESCRIPTION", "Detailed Description", "Zusammenfassung", "RESUMEN", "Abrégé", "What is claimed is:", "权利要求书", "Rotor", "Valve seat"]
ABOUT = [
    'The notice "please enable JavaScript" is suppressed by the proxy described here if the optical fibre is present.',
    'If the battery cell does not answer in time, the terminal shows the message "page not found" and logs the event.',
    "A form letter contains fields such as {{ recipient }} or {{ amount }}, which the merging unit replaces before printing.",
    "The parser replaces each tag of the form <%= name %> by the value read from the conveyor belt.",
    "The variable ${P_MAX} is expanded by the control unit when the gas inlet starts.",
    'Blind text of the kind "lorem ipsum" may be set in order to test the line spacing of the printing plate.',
    "The load distributor answers with status 503 Service Unavailable while the gripper arm is being replaced, and the client repeats the request.",
    'The access checker returns "access denied" (error 403) unless the token matches the stored value.',
    "A bracket such as [insert here] printed on the label marks the place of the polymer matrix.",
    'Until the figures are known, the table holds "TBD" in the column of the editor.',
    "Als Blindtext dient eine Folge von Wörtern, mit der Greifarm geprüft wird.",
    "Lorsque JavaScript est désactivé, la passerelle fournit une page statique.",
    "若线圈无响应，终端显示“页面不存在”并记录该事件。",
]
RESIDUE = [
    ("Page not found", "service"), ("HTTP/1.1 502 Bad gateway The upstream full-text module sent an invalid reply.", "service"), ("Your session has ended Sign in again to continue reading.", "service"),
    ("Too many requests", "service"), ("Seite nicht gefunden", "service"), ("会话已过期", "service"), ("Veuillez réessayer plus tard.", "service"), ("The archive took too long to respond.", "service"),
    ("Please enable JavaScript to view this document.", "script"), ("Your browser does not run scripts, so the full text cannot be shown here.", "script"), ("您的浏览器未开启脚本功能，无法显示全文。", "script"),
    ("Your text goes here. Your text goes here.", "filler"), ("TBD", "filler"), ("XXXXXX", "filler"), ("Hier steht Ihr Text.", "filler"), ("???to be completed by drafter???", "filler"),
    ("Sit dolore magna ipsum aliqua. Nostrud fugiat quis lorem adipiscing magna.", "lorem"), ("shgfhhkha jglfkf kflgksdjk llfkssk ldgjkjj kkfhdajj", "mash"),
    ("{{ invention_title }}", "field"), ("Applicant: <<agent_name>>", "field"), ("[0012] __drawing_list__", "field"), ("Summary: #claimBody#", "field"), ("<?php echo $abstract_text; ?>", "field"),
    ("[insert summary of the invention here]", "prompt"), ("［在此输入摘要］", "prompt"), ("Title: undefined", "empty"), ("Filing Date: NaN", "empty"), ("null", "empty"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    """Mostly prose, as documents are; each piece of residue and each sentence about such things once."""
    texts = ["\n".join([HEADS[i % len(HEADS)], *(PROSE[(i + k) % len(PROSE)] for k in range(9))]) for i in range(600)]
    clean = len(texts)
    texts += ["\n".join([PROSE[0], a, PROSE[1]]) for a in ABOUT]
    about = len(texts)
    texts += ["\n".join([PROSE[i % 4], r, PROSE[(i + 1) % 4]]) for i, (r, _) in enumerate(RESIDUE)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90_000, None), (90_001, ""), (None, "Page not found")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache(), clean, about


def test_residue_is_found_and_prose_is_not(corpus):
    df, clean, about = corpus
    found: dict = {}
    for r in R.residue(df).collect():
        found.setdefault(r["doc_id"], {})[r["kind"]] = r
    assert not [d for d in found if d < clean]
    assert not [df.filter(f"doc_id = {d}").first()["text"] for d in found if clean <= d < about]
    missed = [RESIDUE[i] for i in range(len(RESIDUE)) if about + i not in found]
    assert not missed
    kinds = [(RESIDUE[i], set(found[about + i])) for i in range(len(RESIDUE)) if RESIDUE[i][1] not in found[about + i]]
    assert len(kinds) <= 3, kinds
    assert 90_000 not in found and 90_001 not in found and None not in found


def pieces_of(texts):
    return {piece for t in texts if t for line in t.split("\n") for piece in R.pieces(line)}


@pytest.mark.parametrize("whole_lines", [False, True])
def test_held_out_wordings(spark, data, monkeypatch, whole_lines):
    """Every seed text that a document shows, or every seed line of which a document shows any text, is held out: what the
    full seeds find is found still."""
    table = data.parent / "sf0.1" / "documents.parquet"
    if not table.exists():
        pytest.skip("no test tables here")
    documents = spark.read.parquet(str(table)).select("doc_id", "text").cache()
    full = {r["doc_id"] for r in R.found_documents(documents).collect()}
    shown = pieces_of(r["text"] for r in documents.collect())
    lines, texts = R.seed_lines(), R.seed_texts
    if whole_lines:
        marks = {"prompt": R.PROMPT_MARKS}
        rng = np.random.default_rng(7)
        kept = {k: [line for line in some if k == "lorem" or shown.isdisjoint(m % t for t in R._spread(line, rng) for m in marks.get(k, ["%s"]))] for k, some in lines.items()}
        assert sum(map(len, kept.values())) < 0.9 * sum(map(len, lines.values()))
        monkeypatch.setattr(R, "seed_lines", lambda: kept)
    else:
        monkeypatch.setattr(R, "seed_texts", lambda: {k: [t for t in some if k not in R.LEARNING or t not in shown] for k, some in texts().items()})
    found = {r["doc_id"] for r in R.found_documents(documents).collect()}
    assert len(full) > 500 and len(found & full) >= 0.9 * len(full) and len(found - full) <= 5


def test_no_prose_is_residue():
    seeds = R.Seeds.fit()
    text = "\n".join(PROSE[:7] + HEADS) * 400
    ratio = seeds.ratios(np.bincount(seeds.place[R.slots(R.fold(text))], minlength=seeds.share.shape[1] + 1) * R.WHOLE)
    assert not any(R.judge(PROSE + HEADS, seeds.place, ratio))


def test_a_field_needs_a_spot_of_the_model():
    """The exact check follows the model: marks that the field model has no spot in are nothing."""
    seeds = R.Seeds.fit()
    ratio = seeds.ratios(np.bincount([seeds.share.shape[1]], [1e6], seeds.share.shape[1] + 1))
    assert R.judge(["{{invention_title}}", "The valve is {{x}} mm wide."], seeds.place, ratio) == ["field", "field"]
    ratio[R.KINDS.index("field")] = R.UNSEEN
    assert R.judge(["The valve is {{x}} mm wide."], seeds.place, ratio) == [None]


def test_learning_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(R, "SAMPLE_DOCS", 300)
    monkeypatch.setattr(R, "LEARNED", 1)
    rows = [(i, "Page not found" if i % 10 == 0 else "\n".join(PROSE[:7])) for i in range(1000)]
    found = R.found_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(0, 1000, 10))


def prints_of(texts):
    codes = R.fold("\n" + "\n".join(texts) + "\n")
    return set(R._wordings(codes, R.slots(codes))[1].tolist())


def test_all_wordings_of_all_documents_are_learned(spark, monkeypatch):
    """However many documents and wordings there are: those that two documents of a thousand show, too."""
    monkeypatch.setattr(R, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(R, "LEARNED", 1)
    shown = {10: "The record you wanted could not be opened on our server.", 20: "Please sign in again to the server and retry later.", 30: "The requested record could not be opened, please retry."}
    rows = [(i, shown.get(i // 2 * 2, "\n".join(PROSE[:7]))) for i in range(1000)]
    seeds, _ = R.fitted(spark.createDataFrame(rows, "doc_id bigint, text string"))
    wanted = prints_of(shown.values())
    assert not wanted <= set(R.Seeds.fit().prints.tolist())
    assert wanted <= set(seeds.prints.tolist())


def test_learned_wordings_count_as_training_texts(spark, monkeypatch):
    more = [("service", "The shelf is closed today."), ("service", "No shelf 12"), ("prompt", "[say what it is]"), ("filler", "x"), ("filler", "to be said")]
    texts = R.seed_texts()
    learned = R.Learned.of(spark.createDataFrame(more, "kind string, piece string").repartition(3))
    whole, apart = R.Seeds.fit({k: v + [p for kind, p in more if kind == k] for k, v in texts.items()}), R.Seeds.fit(texts, learned)
    assert (whole.place == apart.place).all() and np.allclose(whole.share, apart.share) and set(whole.prints.tolist()) == set(apart.prints.tolist())
    monkeypatch.setattr(R, "LEARNED", 1)
    few = R.Seeds.fit(texts, learned)
    assert (few.place == whole.place).all() and set(few.prints.tolist()) == set(whole.prints.tolist())
    # lighter, but none is left out
    assert ((few.share > 0) == (whole.share > 0)).all()


def test_clean_documents_keep_their_columns(corpus, spark):
    df, clean, about = corpus
    more = df.selectExpr("*", "1 AS kind", "2 AS example", "3 AS n_pieces")
    kept = R.clean_documents(more)
    assert kept.columns == more.columns
    assert kept.filter(f"doc_id < {about}").count() == about and kept.filter(f"doc_id >= {about} AND doc_id < 90000").count() == 0
    assert kept.filter("doc_id IS NULL OR doc_id >= 90000").count() == 3


def test_very_long_texts_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_CHARS", 5000)
    long = (PROSE[0] + " ") * 3000
    rows = [(1, long), (2, long + "\nPage not found\n" + long), (3, "Page not found"), (3, "Page not found")] + [(10 + i, PROSE[i % 7]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in R.found_documents(df).collect()) == [2, 3]


def test_empty_table(spark):
    assert R.found_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pieces():
    assert R.pieces("[0005] Your text here. Filed: undefined") == ["Your text here.", "undefined"]
    assert R.pieces("ABSTRACT: [0005] {{x}}") == ["{{x}}"]
    assert R.pieces("会话已过期。请重新登录。") == ["会话已过期。", "请重新登录。"]


def test_a_notice_that_a_third_of_all_documents_show(spark):
    rows = [(i, "Your session has ended\nSign in again to continue reading." if i % 3 == 0 else "\n".join(PROSE[:7])) for i in range(600)]
    found = R.found_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(0, 600, 3))


COPIED = [
    "Page not found The requested publication does not exist on this server. It may have been moved or the link is out of date.",
    "The record you wanted could not be opened on our server. Please sign in again and retry later.",
    "Your quota for 2026-11-%02d is used up; please wait before you ask for more pages.",
]


@pytest.mark.parametrize("message", COPIED)
@pytest.mark.parametrize("share", [0.01, 0.34])
def test_copies_do_not_become_prose(spark, message, share):
    """Several seed sentences on a line, other wordings and such with numbers, among prose of many wordings."""
    import random

    rng = random.Random(8)
    words = sorted({w for p in PROSE[:6] for w in p.split()}) + ["".join(rng.choices("aeioubcdfglmnprst", k=rng.randint(3, 10))) for _ in range(4000)]
    texts = ["\n".join([HEADS[i % len(HEADS)], *(" ".join(rng.choices(words, k=30)) + "." for _ in range(3))]) for i in range(2000)]
    copies = int(len(texts) * share / (1 - share))
    # half of them as whole texts, half between others
    shown = [message.replace("%02d", f"{i % 28 + 1:02d}") for i in range(copies)]
    texts += [m if i % 2 else f"{texts[i]}\n{m}\n{texts[i + 1]}" for i, m in enumerate(shown)]
    found = R.found_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(2000, 2000 + copies))


def test_fields_within_sentences_and_short_names(spark):
    within = ["The invention relates to {{technical_field}} and to a valve.", "Inventor: Mr <<n>> of Bern", "{{x}}", "Abstract: {{x}}", "Der Erfinder ist <%= q %>.", "本发明涉及{{ y }}。"]
    none = [*ABOUT, "The label shows “${x}” on the valve.", "$\\frac{{x}}{y}$ is the ratio", "y = {{x}} + 2", "The set {{a}} = {b}"]
    texts = ["\n".join([PROSE[0], t, PROSE[1]]) for t in [*within, *none]] + ["\n".join(PROSE[:7])] * 50
    found = R.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).filter("kind = 'field'")
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(len(within)))
