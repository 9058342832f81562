"""Misread texts."""

import numpy as np

from stockroom.llm import mojibake as M

DOCS = "doc_id long, text string, lang string, runs string, garbled string"
GERMAN = "Die Prüfung der Größe erfolgt für jede Maschine über {0} Stunden; danach läuft die Führung zurück und die Kühlung hält {0} °C."
RUSSIAN = "Устройство по заявке 2024-118-7{0} содержит корпус и крышку, причем подвижная пружина охватывает корпус при {0} градусах"


def misread(text, true, wrong):
    return M.Single(wrong).decode(text.encode(true))


def corpus():
    docs = []
    for i in range(60):
        docs += [(10 * i, GERMAN.format(i % 9), "de", "", ""), (10 * i + 1, RUSSIAN.format(i % 9), "ru", "", "")]
    bad = {}
    for k in range(6):
        g, r = GERMAN.format(k), RUSSIAN.format(k)
        bad |= {10_000 + k: misread(g, "utf_8", "cp1252"), 10_100 + k: misread(r, "koi8_r", "cp1251"), 10_200 + k: misread(misread(g, "utf_8", "cp1252"), "utf_8", "cp1252"), 10_300 + k: g + " Größe " + misread("Kühlung über", "utf_8", "cp1252") + " ok"}
    return docs + [(i, t, "xx", "", "") for i, t in bad.items()], bad


def test_learns_from_twins_finds_and_restores(spark):
    docs, bad = corpus()
    quoting = [(20_000, "The decoder turns the text “GrÃ¶ÃŸe” into Größe and shows “Ã©” for é", "en", "", ""), (20_001, "A mark (�) is shown", "en", "", "")]
    odd = [(20_002, None, None, None, None), (20_003, "", "", "", ""), (20_004, "  ", "", "", ""), (20_005, "plain ASCII", "", "", ""), (20_006, "F�r die Gr��e", "de", "", ""), (0, GERMAN.format(0), "de", "", ""), (20_007, "ä" * 100_000, "", "", "")]
    df = spark.createDataFrame(docs + quoting + odd, DOCS)
    learned = M.learn(df)
    assert "utf_8>cp1252" in learned and "koi8_r>cp1251" in learned
    got = {r.doc_id: r for r in M.restore(df).collect()}
    assert {i for i, r in got.items() if r.garbled} == set(bad) | {20_006}
    for k in range(6):
        assert got[10_000 + k].text == got[10_200 + k].text == GERMAN.format(k) and got[10_100 + k].text == RUSSIAN.format(k) and got[10_300 + k].text.endswith(" Größe Kühlung über ok")
        assert got[10_000 + k].restored
    assert not got[20_006].restored and got[20_002].text is None and got[20_007].text == "ä" * 100_000
    assert {r.doc_id for r in M.found(df).collect()} == set(bad) | {20_006}


def test_empty_table(spark):
    assert M.found(spark.createDataFrame([], DOCS)).count() == 0 and M.restore(spark.createDataFrame([], DOCS)).count() == 0


def test_short_and_long_texts_score_alike():
    rnd = np.random.default_rng(1)
    table = rnd.random(M.BUCKETS).astype(np.float32)
    r = M.Restorer([], table)
    for t in ("für", "данные x", "5 √4", "abc"):
        b = M._pairs_of(t)
        assert abs(r.score(t) - (float(table[b].mean()) if len(b) else 0.0)) < 1e-5


JAPANESE = "【要約】案内レール（10）と駆動軸（2{0}）とを備える小型の弁駆動装置に関する。請求項1から{0}のいずれか一項に記載の装置。温度は9{0} °Cである"


def test_short_runs_of_two_byte_encodings_are_restored(spark):
    docs = [(i, JAPANESE.format(i % 9), "ja", "", "") for i in range(60)]
    bad = {10_000 + k: misread(JAPANESE.format(k), "shift_jis", "cp1252") for k in range(6)}
    mixed = JAPANESE.format(3) + "\n" + GERMAN.format(4)
    bad[10_100] = misread(JAPANESE.format(3), "shift_jis", "cp1252") + "\n" + misread(GERMAN.format(4), "utf_8", "cp1252")
    got = {r.doc_id: r for r in M.restore(spark.createDataFrame(docs + [(i, t, "", "", "") for i, t in bad.items()] + [(i, GERMAN.format(i % 9), "de", "", "") for i in range(100, 130)] + [(200 + i, misread(GERMAN.format(i), "utf_8", "cp1252"), "", "", "") for i in range(6)], DOCS)).collect()}
    assert {i for i, r in got.items() if r.garbled} == set(bad) | {200 + i for i in range(6)}
    for k in range(6):
        assert got[10_000 + k].text == JAPANESE.format(k) and got[10_000 + k].restored
    assert got[10_100].text == mixed and got[10_100].restored


def test_not_restored_while_misread_signs_are_left():
    table = np.ones(M.BUCKETS, np.float32)
    r = M.Restorer(["utf_8>cp1252"], table)
    assert r.text("Die PrÃ¼fung der GrÃ¶ÃŸe")[4] is False and r.text("Die PrÃ¼fung, Teil 1\x962")[4] is True


def test_long_runs_teach_encodings_of_two_bytes(spark):
    docs = []
    for k in range(4):
        clean = "".join(chr(0x4E00 + (i * 37 + k * 101) % 2000) for i in range(300)).encode("euc_jp", "ignore").decode("euc_jp") * 2
        line = f"Reference number {k} of the register "
        docs += [(10 * k + i, line + clean, "", "", "") for i in range(3)] + [(10 * k + 9, line + misread(clean, "euc_jp", "cp1252"), "", "", "")]
        assert len(clean) > 200
    assert "euc_jp>cp1252" in M.learn(spark.createDataFrame(docs, DOCS))


def test_long_runs_and_many_misreadings_are_restored():
    """No length and no number of misreadings is left out."""
    table = np.ones(M.BUCKETS, np.float32)
    r = M.Restorer(["utf_8>cp1252"], table)
    text = "Größe und Maß"
    for _ in range(5):
        text = misread(text, "utf_8", "cp1252")
    assert r.text(text)[0] == "Größe und Maß"
    for n in (300, 5000):
        word = "".join(chr(0x430 + i * 7 % 32) for i in range(n))
        assert M.explanations(word, misread(word, "utf_8", "cp1252")) and "koi8_r>cp1251" in M.explanations(word, misread(word, "koi8_r", "cp1251"))
        assert r.text(f"a {misread(word, 'utf_8', 'cp1252')} b")[0] == f"a {word} b"


def test_rest_of_a_text_is_restored_whatever_its_length():
    """Long runs that alone aren't likely enough follow the words of the same text that are."""
    rnd = np.random.default_rng(2)
    table = rnd.random(M.BUCKETS).astype(np.float32) * 0.1
    long = "".join(chr(0x430 + i * 11 % 32) for i in range(900))
    word = "данные"
    table[M._pairs_of(f" {word} ")] = 9.0
    table[M._pairs_of(f" {long} ")] = 1.0
    r = M.Restorer(["koi8_r>cp1251"], table)
    assert r.text(f"x {misread(word, 'koi8_r', 'cp1251')} y {misread(long, 'koi8_r', 'cp1251')} z")[0] == f"x {word} y {long} z"
