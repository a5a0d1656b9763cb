import random

from folioscope.llm import pii_patterns, privacy

from tests.conftest import rows

DOC = "doc_id long, text string"
NAMES = "name_part string, part_kind string"
GIVEN = "Anna Boris Clara Dario Elena Felix Greta Hugo Ines Jonas Karim Lena".split()
FAMILY = "Arvadell Belosky Caldomez Dornithpor Eskamul Falovic Garrilan Heskoma Ilvuran Jorossen Karmeidze Lethagar".split()


def corpus(n=500, seed=9):
    rng = random.Random(seed)
    rows_, truth = [], set()
    for i in range(n):
        name, phone = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}", rng.choice(["+1 415 555 01", "415-555-01", "(415) 555 01"]) + f"{rng.randint(10, 99)}"
        mail = name.lower().replace(" ", rng.choice("._-")) + rng.choice(["@mail.example", " [at] mail [dot] example", "(at)mail.example"])
        number = f"{rng.choice(['SSN ', 'passport '])}" + f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
        address = f"{rng.randint(1, 200)} {rng.choice(['Quarry', 'Juniper', 'Old Dairy'])} {rng.choice(['Lane', 'Road', 'St'])}, Valawick"
        parts = [
            ("Emergency contact is ", name, "name"), (" (", phone, "phone"), ("). Write to ", mail, "email"), (". Record shows ", number, "id_number"),
            (" for this starter. The laptop goes to ", address, "address"), (". Ticket 15847-9588 was merged. Reported by ", f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}", "name"),
        ]
        text = ""
        for lead, value, kind in parts:
            text += lead
            truth.add((i, kind, len(text) + (value.index(" ") + 1 if kind == "id_number" else 0)))
            text += value
        rows_.append((i, text + ". Invoice no. 8672 2527 19 is for Friday Noon. Summer Party is in May."))
    return rows_, truth


def known(spark):
    return spark.createDataFrame([(g, "given") for g in GIVEN[:8]] + [(f, "family") for f in FAMILY[:6]] + [(None, "family")], NAMES)


def test_entities_are_found_and_the_rest_is_kept(spark):
    data, truth = corpus()
    extra = [(-1, None), (-2, ""), (None, "Anna Belosky"), (-3, "w " * 100_000)]
    df = spark.createDataFrame(data + data[:20] + extra, DOC).selectExpr("*", "1 as start_at", "'x' as sites", "0 as term")
    found = privacy.find_entities(df, known(spark)).cache()
    got = {(r.doc_id, r.pii_type, r.start_at) for r in found.collect()}
    assert len(got) == found.count()
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97
    masked = {r.doc_id: r for r in privacy.sanitise(df.where("doc_id is not null").dropDuplicates(["doc_id"]), known(spark)).collect()}
    text = masked[0].text
    assert text.startswith("Emergency contact is [NAME] ([PHONE]). Write to [EMAIL]. Record shows ") and "Invoice no. 8672 2527 19" in text
    assert masked[-1].text is None and masked[-2].text == "" and masked[-3].text == "w " * 100_000 and masked[-3].replaced == 0


def test_no_term_is_dropped_and_blocks_change_nothing(spark, monkeypatch):
    data, truth = corpus()
    # A name off the list, seen a few times among many, is still known in lower case.
    rare = [(1000 + i, f"Emergency contact is Quilla Zembrano (+1 415 555 01{i:02}). Thanks.") for i in range(6)]
    lower = [(2000, "Emergency contact is quilla zembrano (+1 415 555 0199). Thanks.")]
    df = spark.createDataFrame(data + rare + lower, DOC)
    whole = rows(privacy.find_entities(df, known(spark)).select("doc_id", "pii_type", "start_at"))
    assert (2000, "name", 21) in whole
    monkeypatch.setattr(privacy, "MAX_NAME_TERMS", 0)
    monkeypatch.setattr(privacy, "BLOCK_CHARS", 5000, raising=False)
    assert rows(privacy.find_entities(df, known(spark)).select("doc_id", "pii_type", "start_at")) == whole


def test_names_in_capitals_off_the_list_are_found_by_what_other_texts_tell(spark):
    data, _ = corpus()
    mixed = [(1000 + i, f"Emergency contact is Quilla Zembrano (+1 415 555 01{i:02}). Thanks.") for i in range(8)]
    capitals = [(2000, "EMERGENCY CONTACT IS QUILLA ZEMBRANO (+1 415 555 0199). THANKS."), (2001, "THE OLD TABLE IS HERE.")]
    found = privacy.find_entities(spark.createDataFrame(data + mixed + capitals, DOC), known(spark))
    got = {(r.doc_id, r.pii_type, r.start_at) for r in found.where("doc_id >= 2000").collect()}
    assert (2000, "name", 21) in got and not any(d == 2001 for d, _, _ in got)


def test_lower_words_hold_every_word_that_is_asked_for():
    text = "by quilla zembrano-, smith-@x o’neil--2 d'arc'-/ and de la mcDonald, ana-"
    asked = set()

    def ask(kind, word):
        asked.add(word)
        return True

    pii_patterns.lower_name_sites(text, {"given": set(), "family": set()}, ask)
    assert {w.lower() for w in asked if not any(c.isdigit() for c in w)} <= pii_patterns.lower_words(text)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert rows(privacy.find_entities(empty, known(spark))) == [] and rows(privacy.sanitise(empty, known(spark).limit(0))) == []


def spans(sites, text):
    return [text[s.start : s.end] for s in sites]


def test_email_forms():
    for mail in ("a.b@x.example", "a_b [at] x [dot] co [dot] example", "a at in dot x dot test", "a+c(at)x-hq.example.net"):
        assert spans(pii_patterns.email_sites(f"Write to {mail}, please."), f"Write to {mail}, please.") == [mail]
    for other in ("Pin abc@4.6.5 now", "User at line 3, column 8: dot missing.", "Ask @brand-team in the channel"):
        assert pii_patterns.email_sites(other) == []


def test_number_and_address_starts():
    first = lambda sites, text: text[sites[0].start :]
    text = "call (0221) 4710691 now"
    assert first(pii_patterns.number_sites(text), text).startswith("(0221)")
    text = "call her (+33 1 99 00 07 72)."
    assert first(pii_patterns.number_sites(text), text).startswith("+33")
    text = "call her (7135550162, ext 8)"
    assert first(pii_patterns.number_sites(text), text).startswith("7135550162")
    for address in ("Apt 8, 179 Foxglove Ave, Sanaroblo", "Lerchengasse 108 a, 00294 Ottenby", "94 bis, rue des Tilleuls", "C/ de la Fragua, 40, 1º izq., Marrosby"):
        text = f"lives at {address} now"
        assert first(pii_patterns.address_sites(pii_patterns.plain(text)[0]), text).startswith(address.split(",")[0]), address
    assert pii_patterns.address_sites("Ship the Harrier Road Map 5 weeks early; 24 road trips.") == []


def test_places_in_texts_with_odd_characters():
    text = "Café ​data ＠ x ­ end"
    flat, places = pii_patterns.plain(text)
    assert "@" in flat and "​" not in flat and all(len(flat) == len(places) for _ in [0])
    assert places[flat.index("@")] == text.index("＠")
