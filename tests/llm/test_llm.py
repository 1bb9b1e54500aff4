"""Brute-force comparisons, exact round trips and edge cases of the training-data operators."""

import base64
import datetime as dt
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, mojibake, scans, shapes, splitting, survivors
from quillspark.llm.marks import INVISIBLE, WHITE_SPACE

CANON = "rec_id bigint, chunk_id string, canon_number string, text string, embed_text string, source_kind string, scraped_at timestamp_ntz, hierarchy_path string, in_force_note string, trust int, __key string"


# ---- encoding --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.SegmentTreeBpe(bpe.parse_ranks(bpe.read_vocabulary()))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_public_implementation(encoder, text):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    assert encoder.encode(text) == other.encode_ordinary(text)


def test_encoding_round_trip_and_nulls(spark, encoder):
    texts = [None, "", "<|endoftext|> שלום  עולם\n\n", "a" * 5000, "的" * 900, "x‏😀"]
    docs = spark.createDataFrame([(k, x, "other") for k, x in enumerate(texts)] + [(0, None, "other")], "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(docs).collect()
    back = {i: t for t, i in encoder.ranks.items()}
    assert len(got) == len(texts) + 1
    for row in got:
        assert b"".join(back[i] for i in row["ids"]).decode() == (texts[row["doc_id"]] or "")
    assert bpe.encode_corpus(docs.where("false")).count() == 0


# ---- splitting -------------------------------------------------------------------------------------------------------


def brute_paragraphs(text):
    out, now = [], []
    for line in (text or "").split("\n"):
        bare = line.translate({ord(c): None for c in INVISIBLE})
        if bare.strip(WHITE_SPACE):
            now.append(bare)
        elif now:
            out.append(now)
            now = []
    out += [now] if now else []
    return [re.sub(f"[{re.escape(WHITE_SPACE)}]+", " ", "\n".join(p)).strip(" ") for p in out]


def test_paragraphs_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word", " ", "\n", "\r\n", "\n\n", "‏", "\xa0", "\t", "é.", " "]) for _ in range(120)) for _ in range(40)] + [None, "", " \n​\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id bigint, markdown string")
    got = {}
    for r in splitting.paragraphs(df).orderBy("file_id", "para_no").collect():
        got.setdefault(r["file_id"], []).append(r["body"])
    assert all(got.get(k, []) == brute_paragraphs(t) for k, t in enumerate(texts))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["parola", "a", "lunghissima" * 6, "fine.", "e,", "的中文字符" * 9, "x" * 500]), min_size=1, max_size=160))
def test_pieces(parts):
    text = " ".join(parts)
    cuts = splitting.split_text(text)
    assert cuts[0][:2] == (0, 0) and cuts[-1][2] == len(text)
    for start, _, end in cuts:
        assert 0 < end - start <= 400
    for (_, _, end), (start, new, _) in zip(cuts, cuts[1:]):
        assert new == end and 40 <= new - start <= 80


def test_split_extra_columns(spark):
    df = spark.createDataFrame([(1, "w " * 300, 5, "x"), (1, "w " * 300, 5, "x"), (2, None, 5, "x"), (3, "short", 5, "x")], "file_id bigint, markdown string, piece_no int, body string")
    assert splitting.oversized(df).count() == 2 and splitting.oversized(df.where("false")).count() == 0


# ---- survivors -------------------------------------------------------------------------------------------------------


def test_survivors_equal_brute_force(spark):
    rng, day = random.Random(5), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(1, 400):
        n = rng.choice([1, 1, 1, rng.randint(2, 40)])
        name = rng.choice([f"CIC-it-{n}", f"cic it 00{n}", f" CIC.it.{n}​", f"ＣＩＣ-it-{n}", None, " ", "\xa0"])
        text = rng.choice([None, "", " ", "n/d", "[vuoto]", "—", "abc", "abcd", "a b c d", "ab​cd", "abcdefgh"])
        when = rng.choice([None, day, day + dt.timedelta(days=rng.randint(0, 3))])
        rows.append((k, name, rng.choice([str(n), f"0{n}", None]), text, rng.choice([text, None, "xyz"]), rng.choice([None, "a", "b", "?"]), when, "p", rng.choice([None, "note"]), 9, "z"))
    df = spark.createDataFrame(rows, CANON)
    trust = spark.createDataFrame([("a", 1), ("b", 2)], "source_kind string, trust int")
    import unicodedata

    groups = {}
    for r in rows:
        name = r[1] if r[1] and r[1].strip(" \xa0​") else f"CIC-it-{r[2]}" if r[2] else None
        if name:
            form = "".join(c for c in unicodedata.normalize("NFKC", name).casefold() if c.isalnum())
            groups.setdefault(re.sub(r"(?<!\d)0+(?=\d)", "", form), []).append(r)
    want = set()
    for g in groups.values():
        for field, at in (("text", 3), ("embed_text", 4)):
            live = [r for r in g if r[at] and re.sub(r"[\W_]", "", r[at]).lower() not in ("", "nd", "vuoto")]
            if len(g) > 1 and live:
                best = max(live, key=lambda r: (len(re.sub("[\\s​]", "", r[at])), {"a": 1, "b": 2}.get(r[5], -1), r[6] or dt.datetime(1, 1, 1), -r[0]))
                want.add((min(r[0] for r in g), field, best[0]))
    got = [tuple(r) for r in survivors.survivors_found(df, trust).collect()]
    assert set(got) == want and len(got) == len(want)
    assert survivors.golden_records(df, trust, ("in_force_note",)).count() == len(groups)
    assert survivors.survivors_found(df.where("false"), trust).count() == 0


def test_currency_orders_undated(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(k * 10 + j, f"g{k}", None, "t", "t", kind, day + dt.timedelta(days=j), "p", kind, 1, "z") for k in range(4) for j, kind in enumerate(["a", "b", "c"])]
    rows += [(901, "gx", None, "t", "t", "a", day, "p", "from a", 1, "z"), (902, "gx", None, "t", "t", "c", None, "p", "from c", 1, "z")]
    trust = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "source_kind string, trust int")
    got = {r["chunk_key"]: r for r in survivors.golden_records(spark.createDataFrame(rows, CANON), trust, ("in_force_note",)).collect()}
    assert got["gx"]["in_force_note"] == "from c"  # c follows b follows a wherever rows are dated


def test_precedence_is_a_partial_order():
    chain = survivors.ancestors([("a", "b", 3), ("b", "a", 1), ("b", "c", 1)])
    assert chain == {"b": {"a"}, "c": {"a", "b"}}
    one = survivors.ancestors([("web", "ocr", 5)])
    assert one == {"ocr": {"web"}}  # api and book aren't related to either
    loop = survivors.ancestors([("a", "b", 9), ("b", "c", 8), ("c", "a", 2)])
    assert loop == {"b": {"a"}, "c": {"a", "b"}}  # the weakest pair of the cycle is left out


def test_values_transitions_decide(spark):
    day, rows, rec = dt.datetime(2024, 1, 1), [], 0

    def add(chunk, note, when, kind="a"):
        nonlocal rec
        rec += 1
        rows.append((rec, chunk, None, "t", "t", kind, when and day + dt.timedelta(days=when), "p", note, 1, "z"))

    for k in range(4):  # dated rows: a draft becomes in force, then repealed; "other" is unrelated
        for j, note in enumerate(["draft", "in force", "repealed"], 1):
            add(f"g{k}", note, j)
        add(f"h{k}", "other", 1)
    add("x", "in force", 5), add("x", "repealed", None), add("x", "draft", None)  # repealed follows what is dated
    add("y", "in force", 5), add("y", "draft", None)  # draft doesn't
    add("z", "draft", None), add("z", "repealed", None), add("z", "in force", None)  # nothing dated: the order alone
    add("u", "in force", 5), add("u", "other", None)  # unrelated: the date counts
    add("v", None, 9), add("v", "n/d", 9)
    got = {r["chunk_key"]: r["in_force_note"] for r in survivors.golden_records(spark.createDataFrame(rows, CANON), spark.createDataFrame([("a", 1)], "source_kind string, trust int"), ("in_force_note",)).collect()}
    assert (got["x"], got["y"], got["z"], got["u"], got["v"]) == ("repealed", "in force", "repealed", "in force", None)
    overlapping = [(9, "o", None, "t", "t", k, day + dt.timedelta(days=d), "p", "n", 1, "z") for k, d in (("a", 0), ("b", 1), ("a", 2), ("b", 3))]
    assert survivors.transition_counts(spark.createDataFrame(overlapping, CANON), ["chunk_id"], "source_kind", "scraped_at").count() == 0



# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_allocation_and_mixture(spark):
    goals = mixing.allocate({"a": 100, "b": 900}, [("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 5)])
    assert goals["a"] == 300 and goals["c"] == 0 and abs(sum(goals.values()) - 1000) < 1e-6
    docs = spark.createDataFrame([(k, "one two three " * (1 + k % 5), " A-x " if k % 10 == 0 else "b", "q") for k in range(300)] + [(900, None, "b", "q"), (None, "no id", "b", "q"), (901, "no target", "z", "q"), (902, "none", None, "q")], "doc_id bigint, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("a_x", 0.5, 3), ("b", 0.5, 1), ("empty", 0.0, 1)], "source string, target_share double, max_repeat int")
    mixed = mixing.mixture(docs, targets)
    rows, again = mixed.collect(), mixing.mixture(docs, targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert max(r["copies"] for r in rows if r["source"] == "a_x") <= 3 and max(r["copies"] for r in rows if r["source"] == "b") == 1
    for source in ("a_x", "b"):
        mine = [r for r in rows if r["source"] == source]
        assert abs(mine[0]["actual_share"] - mine[0]["goal_share"]) < 0.02
    assert {r["source"] for r in mixing.mixture_report(mixed, targets).collect()} == {"a_x", "b", "empty"}
    assert mixing.mixture(docs.where("false"), targets).count() == 0


def test_inclusion_frequencies(spark):
    """500 draws of one population (a source each, with ids and so random numbers of its own) include as the design says."""
    words = [1, 1, 2, 3, 5, 8, 13, 21, 34, 200]
    docs = [(k * 100 + i, " one" * n, f"s{k}") for k in range(500) for i, n in enumerate(words)]
    small = sum(words)
    docs += [(10**6 + i, " one" * 100, "big") for i in range(5 * small)]
    targets = [(f"s{k}", 0.9 / 500, 3) for k in range(500)] + [("big", 0.1, 1)]
    mixed = mixing.mixture(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeat int"))
    rows = [r for r in mixed.collect() if r["source"] != "big"]
    goal = 0.9 * (500 * small + 500 * small) / 500
    whole = int(goal // small)
    rest = goal - whole * small
    n = dict(enumerate(words))
    certain = set()
    while True:  # the design, by brute force: certain ones out, the excess spread again
        c = (rest - sum(n[i] for i in certain)) / sum(m * m for i, m in n.items() if i not in certain)
        more = {i for i, m in n.items() if i not in certain and c * m > 1}
        if not more:
            break
        certain |= more
    got = Counter(r["doc_id"] % 100 for r in rows if r["copies"] > whole)
    assert certain and all(got[i] == 500 for i in certain)
    for i, m in n.items():
        if i not in certain:
            p = c * m
            assert abs(got[i] / 500 - p) < 0.05 + 4 * (p * (1 - p) / 500) ** 0.5, (i, got[i] / 500, p)
    assert got[8] > 4 * got[3]  # far from equal probabilities


# ---- wrong decoding --------------------------------------------------------------------------------------------------

CLEAN = [
    "La società à Molière è già perché così più virtù — l'università «può» città.", "Le délégué a été reçu à la mairie; l'élève préfère l'été, voilà où ça mène.", "Die Behörde prüft für das Gebäude die Übergabe, gemäß Abschnitt über Gebühren.",
    "העובד חייב להגיש את המסמך הסרוק במשרד, אלא אם נקבע אחרת בהסכם החתום.", "Заявитель подтверждает решение совета и направляет справка до конца квартала.", "The employer shall return the report “without delay” — and keep the file.", "El año de la petición terminó según la cláusula del convenio más allá del día.",
]


@pytest.fixture(scope="module")
def damaged():
    rng, files, hurt = random.Random(2), [], {}
    pairs = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1252", "cp1251"), ("cp1252", "cp1255"), ("cp850", "utf-8"), ("utf-8", "one byte")]
    for k in range(420):
        lines = [rng.choice(CLEAN) for _ in range(6)]
        if k % 6 == 0:
            wrong, true = pairs[k // 6 % len(pairs)]
            at = rng.randrange(6)
            bad = mojibake.misread(lines[at], wrong, true)
            if bad and bad != lines[at]:
                hurt[k, at + 1] = lines[at]
                lines[at] = bad
        files.append((k, "\n".join(lines), "x"))
    return files, hurt


def test_wrong_decoding(spark, damaged):
    files, hurt = damaged
    df = spark.createDataFrame(files + [(900, None, "x"), (901, "", "x"), (902, "plain ascii", "x")], "file_id bigint, markdown string, line_no string")
    got = {(r["file_id"], r["line_no"]): r["restored"] for r in mojibake.repaired_lines(df).collect()}
    assert len(got.keys() & hurt.keys()) >= 0.97 * len(hurt) and len(got.keys() - hurt.keys()) <= 0.03 * len(hurt)
    exact = [k for k in got.keys() & hurt.keys() if mojibake.LOSS not in got[k]]
    assert sum(got[k] == hurt[k] for k in exact) >= 0.95 * len(exact)
    texts = {r["file_id"]: r["markdown"] for r in mojibake.restored_texts(df).collect()}
    assert texts[900] is None and texts[901] == "" and texts[902] == "plain ascii" and len(texts) == len(files) + 3
    assert mojibake.repaired_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("pair", [p for p in mojibake.PAIRS if p[1] == "utf-8" and p[0] != "gbk" and ">" not in p[0]])
def test_round_trip(pair):
    for line in CLEAN:
        assert mojibake.restore(mojibake.misread(line, *pair), *pair) == line


def model_of(lines):
    pairs = Counter(ab for line in lines for ab in zip("\n" + line, line))
    return mojibake.Model([((ord(a) << 21) | ord(b), 50 * n) for (a, b), n in sorted(pairs.items())])


GREEK, HAN = "Η αίτηση υποβάλλεται στην αρμόδια υπηρεσία πριν από το τέλος του μήνα.", "機關應於收到申請後十日內作出書面決定並通知申請人。"


@pytest.mark.parametrize("line, pair", [(CLEAN[0], ("cp1253", "cp1252")), (CLEAN[4], ("cp1255", "cp1251")), (CLEAN[4], ("cp1256", "cp1251")), (GREEK, ("cp1252", "cp1253")), (HAN, ("cp1252", "big5"))])
def test_pairs_of_own_state(line, pair):
    assert model_of([*CLEAN, GREEK, HAN]).repair_text(mojibake.misread(line, *pair) + "\n" + CLEAN[5]) == {0: line}


@pytest.mark.parametrize(
    "line",
    [
        "Η αίτηση υποβάλλεται στο γραφείο", "Wniosek złożono w urzędzie; źródło: księga", "Başvuru müdürlüğe yapılır, şirket çalışanları", "คำร้องยื่นต่อสำนักงาน", "Žádost se podává u příslušného úřadu",
        "The archive confirms the delay about do\xad", "rul■, the caretaker does not replace the employer", "LA SOCIETÀ È GIÀ PERCHÉ COSÌ PIÙ VIRTÙ", "ЗАЯВИТЕЛЬ ПОДТВЕРЖДАЕТ РЕШЕНИЕ СОВЕТА", "en 1990¬¬ la société", "Ångström Albees Ærø, Łódka, Þing",
    ],
)
def test_clean_text_of_unseen_scripts_stays(line):
    assert model_of(CLEAN * 4).repair_text(line + "\n" + CLEAN[1]) == {}


def test_a_large_alphabet_shares_slots_and_loses_nothing(monkeypatch):
    text = [*CLEAN, GREEK, HAN]
    bad = [mojibake.misread(line, "cp1252", "utf-8") for line in text if mojibake.misread(line, "cp1252", "utf-8") != line]
    whole = model_of(text)
    monkeypatch.setattr(mojibake, "DENSE", 200)
    monkeypatch.setattr(mojibake, "SHARED", 40)
    tight = model_of(text)
    assert set(tight.suspects(bad + text)) >= set(whole.suspects(bad + text)) >= set(range(len(bad))) and tight.gains[0].shape == (200, 200)


def test_long_lines_teach_as_short_ones_do():
    line = "the measure is 3 × 4 m and l'été dura ½ mois. " * 200
    assert len(line) > 5000 and mojibake.trustworthy(line) == mojibake.trustworthy(line[:46])


def test_a_span_takes_in_a_first_character_that_looks_clean():
    line = "通常，承租人可以转让承租人在季度结束之前关于取暖补贴。"
    bad = mojibake.misread(line, "cp1252", "utf-8")
    model = model_of([*CLEAN * 4, HAN])
    labels = [0, *[1] * (len(bad) - 1)]
    assert bad[0] == "é" and model.repair(bad, labels)[0] == line


def test_spans_of_many_pairs_in_a_line():
    pairs = [(CLEAN[0], ("cp1252", "utf-8")), (CLEAN[1], ("cp1250", "utf-8")), (CLEAN[4][:22], ("cp1252", "cp1251")), (CLEAN[3][:20], ("cp1252", "cp1255"))]
    line = " The employer shall keep the file and return the report. ".join(mojibake.misread(text, *pair) for text, pair in pairs)
    assert model_of([*CLEAN, GREEK, HAN]).repair_text(line) == {0: " The employer shall keep the file and return the report. ".join(text for text, _ in pairs)}


# ---- scans -----------------------------------------------------------------------------------------------------------


def test_scan_noise(spark):
    rng, words = random.Random(4), "the employer should confirm registered company without further notice under the same conditions insulation".split()
    clean = [(k, " ".join(rng.choice(words) for _ in range(400)), "x") for k in range(60)]
    page = "The employer should confirm the registered company without fur-\nther notice under the same conditions. The emp|oyer should not\nconfirm insu1ation without the registered company under notice\n\n- 4 -\n\nRUNNING HEADER OF THE FILE\n\nunder the same conditions without further notice. The employer\nshould confirm the registered company without further notice on\n\n- 5 -\n\nRUNNING HEADER OF THE FILE\n\nthe same conditions, the employer should confirm the registered."
    df = spark.createDataFrame([*clean, (900, page, "x"), (901, None, "x"), (902, " \n", "x")], "file_id bigint, markdown string, kinds string")
    got = {(r["line_no"], r["noise"]) for r in scans.noise_found(df).where("file_id = 900").collect()}
    assert got == {(1, "hyphen"), (2, "glyph"), (3, "glyph"), (5, "furniture"), (7, "furniture"), (12, "furniture"), (14, "furniture")}
    text = " ".join(r["paragraph"] for r in scans.continuous_paragraphs(df).where("file_id = 900").orderBy("para_no").collect())
    assert "without further notice" in text and "insulation" in text and "employer should not" in text and "HEADER" not in text
    assert scans.noise_found(df.where("false")).count() == 0


def test_noisy_copy_of_a_header_counts():
    body = ["the employer should confirm the registered", "company without further notice under the"]
    lines = [*body, "Annual Report 2019", *body, "Annual Report 2020.", *body, "annual report 2021", *body]
    assert 2 in scans.furniture(lines, 45, scans.Lexicon({}))


def test_confusions():
    assert scans.explained("insu1ation", "insulation") == [4] and scans.explained("modem", "modern") is not None and scans.explained("abc", "xyz") is None
    assert scans.explained("c0n7rac7ua1", "contractual") == [1, 3, 7, 10] and scans.explained("1nternat|0na1", "international") == [0, 8, 9, 12]
    assert scans.Lexicon({"contractual": 9, "international": 9}).correct("1nternat|0na1,")[0] == "international"
    assert scans.Lexicon({"regional": 9, "original": 9}).correct("reg■onal")[0] == "regional" and scans.is_page_number("pag. " + " " * 30 + "12")
    assert scans.skeleton("concerriing") == scans.skeleton("concerning") and scans.explained("concerriing", "concerning") == [6]
    assert scans.Lexicon({"vigilanza": 9}).correct("vig¬¬lanza;") == ("vigilanza", [3]) and scans.is_page_number("ll/ll") and not scans.is_page_number("il/la")
    assert scans.skeleton("arrenclatario") == scans.skeleton("arrendatario")


# ---- shapes ----------------------------------------------------------------------------------------------------------


def test_shapes(spark):
    rng = random.Random(6)
    nouns, verbs = ["the tenant", "the archive", "the contract", "the warranty", "the annual return"], ["confirms", "updates", "should keep", "may suspend"]
    say = lambda: f"{rng.choice(nouns).capitalize()} {rng.choice(verbs)} {rng.choice(nouns)} without further notice."
    prose = [(k, " ".join(say() for _ in range(6)) + "\n\n" + say(), "prose") for k in range(80)]
    lists = [(100 + k, "\n".join(f"{i}. {rng.choice(nouns)}" for i in range(1, 9)), "list") for k in range(10)]
    tables = [(200 + k, "\n".join(f"{rng.choice(nouns)} | {rng.random():.2f} | {rng.randint(1, 99)}%" for _ in range(8)), "table") for k in range(10)]
    junk = [(300 + k, base64.b64encode(bytes(rng.randrange(256) for _ in range(200))).decode(), "junk") for k in range(5)] + [(400 + k, "".join(rng.choice("#~{}[]<>=|&*") for _ in range(150)), "junk") for k in range(5)]
    docs = prose + lists + tables + junk
    df = spark.createDataFrame([*docs, (900, None, "x"), (901, " ‏", "x")], "doc_id bigint, text string, shape string")
    got = {r["doc_id"]: r["shape"] for r in shapes.document_shapes(df).collect()}
    assert got == {k: s for k, _, s in docs}
    stats = {r["doc_id"]: r for r in shapes.text_statistics(df, spark.createDataFrame([("en", "the")], "lang string, word string")).collect()}
    assert stats[900]["n_words"] == 0 and stats[900]["common_words"] is None and stats[0]["punctuated_lines"] == 1.0 and stats[0]["common_words"] > 0.1
    assert shapes.document_shapes(df.where("false")).count() == 0
