import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.llm import languages, pairs

SAMPLES = {
    "en": ["The bursar keeps the team caps in the clubhouse.", "Each player must return them before the first whistle.", "Lights at the tea room go off at nine.", "Refunds need two signatures from the club.", "Please park behind the hall and leave the lane clear."],
    "de": ["Die Eltern müssen die Trikots bis Ende Mai zurückgeben.", "Der Beitrag für die Gruppe wird im März fällig.", "Wer krank ist, bleibt zu Hause und sagt ab.", "Bitte bringt die Netze so bald wie möglich zurück.", "Neue Mitglieder melden sich in der Halle."],
    "fr": ["Les parents attendent au gymnase et ne restent pas au bord du terrain.", "La cotisation est de six euros et se règle auprès des bénévoles.", "Merci de rapporter les maillots dès que possible.", "Nous avons acheté les ballons grâce à la fête.", "Le règlement du groupe change peu cette année."],
    "es": ["Los nuevos socios esperan en la sede hasta que llegue la lista.", "Quien pierda los chalecos tendrá que abonar diez euros al club.", "El autobús sale el jueves y vuelve por la noche.", "Hacen falta voluntarios para montar las redes.", "Las normas del grupo cambian poco este año."],
    "nl": ["De regels voor de groep van de jeugd veranderen dit jaar nauwelijks.", "Wie ziek is, blijft thuis en meldt zich af.", "Ouders moeten de hesjes voor het einde van mei terugbrengen.", "Met de opbrengst van het feest hebben we de netten gekocht.", "Zonder toestemming mag niemand bij de poort filmen."],
    "pt": ["Os novos sócios esperam no portão até chegar a lista.", "A quota é de quatro euros e paga-se no cais.", "Não é permitido filmar a turma sem autorização dos pais.", "Quem estiver doente não vem ao treino e avisa antes.", "As regras da turma mudam pouco este ano."],
}
ROWS = [(lang, t) for lang, ts in SAMPLES.items() for t in ts]
FAQ = "faq_id string, category string, question string, answer string, updated string, defect string, k int, context string"
DOCS = "doc_id long, text string, lang string, source string, langs string, label string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=10), st.lists(st.sampled_from("abc"), max_size=10))
def test_suffix_automaton(q, a):
    got = pairs.SuffixAutomaton(q).match_lengths(a)
    text = "".join(q)
    for i in range(len(a)):
        assert got[i] == max((n for n in range(i + 2) if "".join(a[i - n + 1 : i + 1]) in text), default=0)


def test_phrases_and_delimiters():
    assert pairs.refuses("Sorry, I DON’T have any details about that!") and pairs.refuses("Das weiß ich nicht.")
    assert not pairs.refuses("We are unable to refund match money once the game has begun.") and not pairs.refuses("Sorry, bibs may not be left here.")
    assert pairs.open_delimiters("a (b [c] d") == 1 and pairs.open_delimiters("a (b) “c” d)") == 0


def defects(frame, rows):
    made = [(f"F{i}", "c", q, a, "", "x", 1, "y") for i, (q, a) in enumerate(rows)]
    df = frame([*made, *made[:3]], FAQ)
    got = pairs.broken_pairs(df, frame(ROWS, "lang string, text string")).collect()
    assert len(got) == len({r.faq_id for r in got})
    return {int(r.faq_id[1:]): r.defect for r in got}


def test_kinds(frame):
    sound = [("Where do we park?", "Please park behind the hall and leave the lane clear for carers.")] * 6 + [("When are the lights off?", "Lights at the tea room go off at nine sharp in June.")] * 6 + [("Who keeps the caps?", "The bursar keeps the team caps in the clubhouse at Dunmoor.")] * 6
    cases = [
        ("Where do we park?", None, "empty"), ("Where do we park?", "  \n", "empty"), ("Where do we park?", "TBC.", "empty"), ("Where do we park?", "(none)", "empty"), (None, None, "empty"),
        ("Where do we park?", "Re: where do we park?", "copy"), ("Where do we park?", "we park", "copy"), ("Where do we park?", "Where do we park? Thanks.", "copy"),
        ("Where do we park?", "Where do we park? Please park behind the hall.", None),
        ("Where do we park?", "I'm sorry, but I don't have any details about that.", "refusal"), ("Wo ist das?", "Darüber liegen mir keine Angaben vor.", "refusal"),
        ("Where do we park?", "Please park behind the hall and leave the", "truncated"), ("Where do we park?", "Lights at the tea room go off at…", "truncated"), ("Where do we park?", "Please park (behind", "truncated"), ("Where do we park?", "The bursar keeps the team ca", "truncated"),
        ("Where do we park?", "The bursar keeps the team caps in the clubhouse at Dunmoor", None), ("Where do we park?", "Lights at the tea room go off at nine sharp in June", None), ("Where do we park?", "No.", None),
        ("Where do we park?", "Les parents attendent au gymnase et ne restent pas au bord du terrain.", "other_language"), ("Where do we park?", "Please say “mise en place” and park behind the hall.", None),
        (None, "Please park behind the hall.", None), ("", "", "empty"), ("Where do we park?", "word " * 50_000 + "end.", None),
    ]
    got = defects(frame, [(q, a) for q, a, _ in cases] + sound)
    assert got == {i: d for i, (_, _, d) in enumerate(cases) if d}


def test_single_pairs(frame):
    """One row at a time: nothing is known of other answers, so contexts never seen are no evidence."""
    q = "When does the gym open on Sunday?"
    cases = [
        ("The desk opens on weekdays at nine", None), ("The hall stands beside the river", None), ("Volunteers from the parish lead every rehearsal", None), ("£250", None), ("Tuesday at 6:30 am", None),
        ("If you are unsure, do not say I have no idea; ask the office on Monday.", None), ("The sign says that staff cannot provide parking permits after six.", None),
        ("The gym opens at nine, but as an AI club project we also open online.", None), ("I can't say for March, but from April the gym opens at nine on Sundays.", None),
        ("That falls outside my remit.", "refusal"), ("Sorry, this is something I'd rather leave to staff.", "refusal"), ("Mi dispiace, non posso rispondere a questa domanda.", "refusal"), ("I'm afraid I don't know when it opens.", "refusal"),
        (f"{q} The club is pleased to receive this query.", "copy"), (f"Thanks for your question: {q}", "copy"), (f"{q} At nine.", None), (f"{q} No.", None),
        ("Rules (see page 3: members only.", None), ("Rules are on page 3 (see", "truncated"), ("The gym opens at nine because", "truncated"), ("The gym opens between the", "truncated"),
    ]
    votes = pairs.Votes(ROWS)
    for answer, defect in cases:
        found, other, prior, contexts, _ = pairs.judge_pair(q, answer, votes)
        assert (found or ("truncated" if contexts and prior == 0 else other)) == defect, answer
    samples = frame(ROWS, "lang string, text string")
    for answer, defect in (cases[0], cases[-1]):
        got = pairs.broken_pairs(frame([("F", "c", q, answer, "", "x", 1, "y")], FAQ), samples).collect()
        assert [r.defect for r in got] == [defect] * bool(defect)


def test_deliveries_of_one_id_are_judged_apart(frame):
    df = frame([("F", "c", "Where?", "Please park behind the hall.", "", "x", 1, "y"), ("F", "c", "Where?", None, "", "x", 1, "y"), (None, "c", "Where?", "", "", "x", 1, "y")], FAQ)
    got = pairs.broken_pairs(df, frame(ROWS, "lang string, text string")).collect()
    assert sorted((r.faq_id or "", r.defect) for r in got) == [("", "empty"), ("F", "empty")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab .,3\n", max_size=30), max_size=5))
def test_continuations_against_brute_force(texts):
    context, total, ended = pairs.Continuations(2).counts(texts)
    got = {c: (t, e) for c, t, e in zip(context.tolist(), total.tolist(), ended.tolist(), strict=True)}
    want = {}
    for text in texts:
        tokens = ["\0", *pairs._TOKEN.findall(text), "\0"]
        for i, t in enumerate(tokens[:-1]):
            name, before = pairs._canonical(t), pairs._canonical(tokens[i - 1])
            if name == "^":
                continue
            after = tokens[i + 1]
            keys = [("", e) for e in ()]
            if after[0] not in "\n\0":
                end = int(after[0] in ".!?…")
                one = pairs._token_hash(name)
                keys += [(one, end), (one + pairs._STEP * pairs._token_hash(before), end)]
            keys += [(pairs._token_hash(t[:n] + "*") + pairs._STEP * pairs._token_hash(before), 0) for n in range(2, len(t)) if name.isalpha()]
            for key, end in keys:
                key = pairs._signed(key & pairs._MASK)
                n, e = want.get(key, (0, 0))
                want[key] = (n + 1, e + end)
    assert got == want


def test_empty_pairs(frame):
    assert pairs.broken_pairs(frame([], FAQ), frame(ROWS, "lang string, text string")).count() == 0
    assert pairs.broken_pairs(frame([("F", None, None, "x y z.", None, None, None, None)], FAQ), frame([], "lang string, text string")).count() == 0


@pytest.fixture(scope="module")
def model():
    return languages.fit(ROWS)


def test_held_out_sentences(model):
    rng = random.Random(1)
    for lang, ts in SAMPLES.items():
        words = " ".join(ts).split()
        mixed = [languages.words_of(" ".join(rng.sample(words, 9))) for _ in range(20)]
        best = languages.similarities(mixed, model)[0].argmax(1)
        assert sum(model.langs[i] == lang for i in best) >= 18


#: Texts in languages that no labelled sentence is in, near ones among them.
UNKNOWN = [
    "I genitori devono riportare le maglie entro la fine di maggio. La riunione del gruppo giovanile si tiene a marzo nella palestra. Chi perde il gilet paga dieci euro al club prima della partita.",
    "Els pares han de tornar les samarretes abans de final de maig. La reunió del grup juvenil es fa al març al camp de baix. Qui perdi l'armilla ha de pagar deu euros al club.",
    "Forældrene skal aflevere trøjerne inden udgangen af maj. Mødet for ungdomsgruppen holdes i marts i hallen. Den der mister vesten betaler ti euro til klubben.",
    "Föräldrarna måste lämna tillbaka tröjorna före slutet av maj. Mötet för ungdomsgruppen hålls i mars i hallen.",
    "Foreldrene må levere tilbake trøyene før slutten av mai. Møtet for ungdomsgruppen holdes i mars i hallen.",
    "Rodzice muszą zwrócić koszulki do końca maja. Spotkanie grupy młodzieżowej odbywa się w marcu w hali.",
    "Părinții trebuie să returneze tricourile înainte de sfârșitul lunii mai. Ședința grupului de tineret este în martie în sală.",
    "Veliler formaları mayıs sonuna kadar geri getirmelidir.",
    "Ωμέγα ψυχή λόγος θάλασσα ἄνθρωπος.",
]


@pytest.mark.parametrize("text", UNKNOWN)
def test_rejection(text):
    path = Path("/root/testdata/sf0.01/lang_samples.parquet")
    if not path.exists():
        pytest.skip("no labelled sentences")
    full = languages.fit([(r["lang"], r["text"]) for r in pq.read_table(path).to_pylist()])
    langs, main, _, segments = languages.label_documents([text], full)[0]
    assert (langs, main, segments) == ([], None, [])
    own = [r["text"] for r in pq.read_table(path).to_pylist()]
    found = languages.label_documents(own, full)
    assert sum(bool(x[0]) for x in found) == len(own)


def test_confidence(model):
    sims, _ = languages.similarities([languages.words_of(x) for x in ("Die Eltern müssen die Trikots bis Ende Mai zurückgeben.", "", "123")], model)
    assert 1 / 6 <= float(languages.confidence(sims)[0]) <= 1 and not sims[1:].any()


def test_document_languages(frame):
    en, de, fr = (" ".join(SAMPLES[x][:3]) for x in ("en", "de", "fr"))
    rows = [
        (1, en, "English", "x"), (2, en, None, "x"), (3, en, "de-DE", "x"), (4, f"{en}\n\n{SAMPLES['de'][0]}\n\n{en}", "en", "x"), (5, f"{en} As they say, “Sport frei, bis bald”.", "EN_us", "x"), (6, None, None, "x"), (7, " \n ", None, "x"),
        (8, f"# Fahrten\n\n{de}", "deutsch", "x"), (9, f"{en} {SAMPLES['fr'][0]} {SAMPLES['fr'][1]} {en}", "en", "x"), (10, f"{en} {SAMPLES['fr'][0]} {en}", "en", "x"), (11, de.upper(), "zxx", "x"), (12, "> The bursar keeps the\n> team caps in the\n> clubhouse and the hall.", "en", "x"), (13, fr * 2000, "fr", "x"), (14, "12 – 15", None, "x"),
    ]
    df = frame([(*r, "clash", "clash") for r in rows], DOCS)
    found = languages.document_languages(df, frame(ROWS, "lang string, text string"))
    got = sorted(tuple(r) for r in languages.mislabelled(found).collect())
    assert got == [(2, "en"), (3, "en"), (4, "de"), (4, "en"), (9, "en"), (9, "fr"), (11, "de")]
    by = {r.doc_id: r for r in found.collect()}
    assert by[4].lang == "en" and by[7].lang is None and by[14].langs == [] and 0 < by[1].confidence <= 1
    segs = languages.language_segments(found).filter("doc_id = 4").orderBy("segment").collect()
    assert [s.lang for s in segs] == ["en", "de", "en"] and rows[3][1][segs[1].start : segs[1].stop] == SAMPLES["de"][0]
    assert languages.document_languages(df.limit(0), frame(ROWS, "lang string, text string")).count() == 0
    assert languages.mislabelled(languages.document_languages(df, frame([], "lang string, text string"))).count() == 0
