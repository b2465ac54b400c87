"""Residue: what is a case and what only looks like one; labels over near-duplicates."""

import pytest

from tarnstone.llm import residue

CASES = [
    "Dear {{policy_holder}},\nwe write.", "Filiale: <noch auszufüllen>", "Agreed by «DISCOUNT_RATE» today", "Of the #REF! policies, most", "Signed: ____________", "The rate of XX.XX % holds", "due on xx/xx/20xx as said", "Stichtag: [folgt]",
    "保单号: 【请填写】", "Branch: %(amount)d", "Reporting year: TBD", "Montant: NaN", "Firmante: undefined", "The ratio for [Your reserve total] rose", "Signed: &lt;reviewer&gt;", "By *** FILL IN *** only", "Line: @@BRANCH@@", "Agence: (à compléter)", "No effect on the stress ........................ was found",
    "The rest.\n\n__table number__", "Two words\nllf kklsrfr kwl",
    "Lorem sed morta ferrunt eget cras.", "Text text text text.", "kfwsssf eafe fkwf fqldelk lqdj slas akd",
    "503 Bad Gateway", "Home > Library\nOops! That page can't be found.", '{"status": 500, "error": "upstream timeout", "trace": "9129ee00"}', "Traceback (most recent call last):\n  File \"render.py\", line 2", "504 页面未找到", "Zugriff verweigert.",
    "You need to enable JavaScript to run this app.", "VEUILLEZ ACTIVER JAVASCRIPT POUR LIRE CE DOCUMENT.", "您的浏览器已禁用脚本。",
]
NO_CASES = [
    "The field `{{reviewer}}` is filled from the register at print time.", "```\nexport RATE=${BRANCH}\nprintf '%s' \"$RATE\"\n```", "Let the set {x : x > 3} hold, with w[i] in [0, 1] and index {1, 2, 3}.", "for(int i=0;i<n;i++){sum+=w[i]*x[i];} // total",
    "[See Table 13] and [Annex XX] give the split; the wording \"to be completed by the cedent\" [sic] stems from it.", "________________\n\nVolume XX, no. 33\n\n________________", "The marker <|endoftext|> was typed by hand.", "Unit TBD (technical balance desk) booked #710 under account <60>.",
    "In 2018 the portal returned error 500 for 17 minutes.", "A total of 404 claims were not found in the register.", "La mention « à compléter » figurait dans le modèle.", "Die Fehlermeldung „Seite nicht gefunden“ trat nur im Test auf.", "The ratio is undefined when exposure is zero.",
    "The portal also works when JavaScript is disabled, which the review asked for.", "Access to the vault was denied to two signatories.", "An earlier draft still held sample text and one lorem ipsum paragraph in section 4.", "旧版门户曾提示“页面未找到”，新版已修复该问题。", "======", "| a | b |\n|---|---|", "Scope ........ 12",
]


def kinds(text):
    return {residue.kind_of(s) for s in residue.segments(text)} - {None}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert kinds(text)


@pytest.mark.parametrize("text", NO_CASES)
def test_no_cases(text):
    assert not kinds(text)


def test_documents(spark):
    message = "We could not open this paper because the reader service is closed for all guests of the library until further notice today"
    near = message.replace("today", "now")
    plain = "The supervisor asked for evidence of the lapse assumptions in the second half of the year, and the board agreed to it."
    rows = [(1, CASES[0]), (2, plain), (3, None), (4, ""), (5, "  \n"), (6, plain + " " + CASES[-3]), (1, CASES[0]), (None, CASES[0]), (7, "x " * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue_documents(frame).collect()} == {1, 6}
    assert residue.residue_documents(frame.limit(0)).count() == 0
    # a label goes on from segment to segment, but only over similar ones
    def row(i, text, kind):
        return (i, i, int(residue.SimHasher().hashes([text.split()])[0]), kind, text)

    chain = [row(1, message.lower(), "message"), row(2, near.lower(), None), row(3, plain.lower(), None)]
    segments = spark.createDataFrame(chain, "doc_id bigint, segment_id bigint, simhash bigint, residue string, normal string")
    if (chain[0][2] ^ chain[1][2]).bit_count() <= residue.RADIUS:
        assert {r.segment_id for r in residue.spread(segments).collect()} == {1, 2}


def test_spread_against_all_pairs(spark):
    """Sentences with one or a few words replaced, put in or taken out: all that are similar get the label."""
    import random

    random.seed(20)
    words = [f"w{i}" for i in range(3000)]

    def grams(text):
        w = text.split(" ")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    seeds = [" ".join(random.choices(words, k=k)) for k in (8, 10, 12, 15, 20, 25, 30, 40, 60, 90, 200) for _ in range(6)]
    others = []
    for seed in seeds:
        for _ in range(12):
            w = seed.split(" ")
            for _ in range(random.choice((1, 1, 1, 2, 3))):
                at = random.choice((0, len(w) - 1, random.randrange(len(w))))
                w[at : at + random.randint(0, 1)] = random.choices(words, k=random.randint(0, 1))
            others.append(" ".join(w))
    others = sorted(set(others) - set(seeds))
    texts, hasher = seeds + others, residue.SimHasher()
    hashes = hasher.hashes([t.split(" ") for t in texts]).tolist()
    rows = [(i, i, h, "message" if i < len(seeds) else None, t) for i, (t, h) in enumerate(zip(texts, hashes))]
    # all pairs, a link further in each round
    sets, want = [grams(t) for t in texts], set(range(len(seeds)))
    front = want
    while front:
        front = {j for j in range(len(texts)) if j not in want for i in front if len(sets[i] & sets[j]) >= residue.SIMILARITY * len(sets[i] | sets[j])}
        want |= front
    assert len(want) > len(seeds) + 200
    frame = spark.createDataFrame(rows, "doc_id bigint, segment_id bigint, simhash bigint, residue string, normal string")
    assert {r.segment_id for r in residue.spread(frame).collect()} == want


def test_keys_of_documents(spark):
    """A message with one word more, too far off for the SimHashes, makes its document residue."""
    message = "your browser is not supported by the old reader of the library"
    longer = message.replace("your", "now your")
    a, b = residue.SimHasher().hashes([message.split(" "), longer.split(" ")]).tolist()
    assert (a ^ b).bit_count() > residue.RADIUS and residue.kind_of(longer) is None and residue.kind_of(message)
    frame = spark.createDataFrame([(1, message + "."), (2, longer + "."), (3, "The board met in May and said nothing of the reserve.")], "doc_id bigint, text string")
    assert {r.doc_id for r in residue.residue_documents(frame).collect()} == {1, 2}


def test_labels_go_over_blocks(spark):
    """Wording that no sign knows: what goes with residue in blocks is residue elsewhere too, prose
    and what stands mostly without it are not. The trusted signs alone find fewer documents."""
    prose = "The board looked at the claims of the third quarter and asked for more."
    rows = [
        (1, "Votre titre ici\nCeci est un faux texte pour la mise en page.\nTexte de remplissage."), (2, "Texte de remplissage.\nCeci est un faux texte pour la mise en page.\nVotre titre ici"),
        (3, f"{prose}\n\nTexte de remplissage.\n\nThe end."), (4, f"{prose} Votre titre ici"), (5, "Your session has expired.\nKindly say your name again."), (6, "Your session has expired.\nKindly say your name again.\n\n" + prose),
        (7, "Kindly say your name again."), (8, f"Home\nZugriff verweigert.\n{prose}"), (9, f"Home\nAccess denied.\n{prose}"), (10, prose), (11, "Home\n\n" + prose), (12, "Home"), (13, "Home"), (14, prose + " Home"), (15, prose),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    seeds = {i for i, text in rows if kinds(text)}
    assert seeds == {1, 2, 5, 6, 8, 9}
    assert {r.doc_id for r in residue.residue_documents(frame).collect()} == seeds | {3, 4, 7}


def test_blocks():
    assert residue.blocks("# A b\r\nc. D\r\n \t\r\n\r\ne\ff") == [["a b", "c", "d"], ["e"], ["f"]]
    assert residue.blocks(" \n\n ") == [] == residue.blocks("") and residue.segments("A.\n\nB") == ["a", "b"]


def test_long_messages():
    """A message with an open end is one however long its line is."""
    paths = " ".join(f"/srv/papers/volume{i}/reserve/table{i}" for i in range(20))
    assert kinds(f"Warning: Undefined index {paths} on line 12") == {"message"}
    assert kinds("Please enable JavaScript to read the papers of the library " + "and the notes of the reserve committee " * 5) == {"message"}
    assert not kinds("The board asked why please enable JavaScript to read the papers was shown " + "and the notes of the reserve committee " * 5)


def test_same_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    from tarnstone import runtime

    rows = [(i, text) for i, text in enumerate(CASES + NO_CASES)] + [(1000 + i, "Texte de remplissage.\nCeci est un faux texte pour la mise en page.") for i in range(3)] + [(2000, "A line.\n\nTexte de remplissage.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    small = {(r.doc_id, tuple(r.kinds), r.n_segments) for r in residue.residue_documents(frame).collect()}
    assert {i for i, _, _ in small} == set(range(len(CASES))) | {1000, 1001, 1002, 2000}
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, tuple(r.kinds), r.n_segments) for r in residue.residue_documents(frame).collect()} == small
