import time

import pytest

from tidelog.llm.sentences import split_sentences

CASES = [
    ["It costs 5.97 km.", "See http://a.example/x?b=3 for v1.2.3."],
    ["Dr. Smith met J. R. Doe at 5 p.m. on No. 4.", "Then, e.g. later, they left!", "Why?!"],
    ["Bros. Inc. sells nuts, etc.", "The end…", "Well… it goes on."],
    ['"He said so. Really!" says the map.', 'She says: "It is. Or not?"', "Next."],
    ["The dog (see fig. 5. It is old.) sleeps."],
    ["A line\nbreaks here."],
    ["iPhone came.", "eBay too."],
    ["Am 6. Mai kam er, z. B. mit Hr. X und Dipl.-Ing. Y, bzw. ohne.", "„Es ist so. Ja!“ sagt er."],
    ["« Il part ? Oui ! » dit-il.", "Il dit : « Non. »", "Fin ?"],
    ["¿Quién es la Sra. Paz?", "Nadie, p. ej. Juan."],
    ["Он пришёл, т. е. ушёл, на 40 тыс. руб.", "Д-р Иванов и пр.", "«Да. Нет!» говорит он."],
    ["Πού είναι ο χάρτης;", "Εδώ, π.χ. κάτω."],
    ["雪说：“很好。真的？”", "老桥...在山后。", "“好。”他说。", "在山后，画家买了5.61m³。"],
    ["「行きます。はい！」と言います。", "Dr.Aは市場で見ます。"],
    ["यह घर है।", "डॉ. राम आए.", "“हाँ। नहीं?” वह कहता है।"],
    ["هل هذا بيت؟", "قال د. علي نعم."],
    ["หิมะซ่อมโคมไฟทุกเช้าที่ตลาดค่ะ", "ที่ตลาด คนสวนขนกาทองแดงไหม?", "ช่างทอขนสถานีริมแม่น้ำ และเชือก ฯลฯ"],
]


@pytest.mark.parametrize("units", CASES, ids=lambda u: u[0][:12])
def test_units(spark, units):
    text = ("" if units[0][0] in "雪「" else " ").join(units)
    df = spark.createDataFrame([(1, text, "zz", "p")], "doc_id long, text string, lang string, piece string")
    rows = sorted(split_sentences(df, "text", ["doc_id"]).collect(), key=lambda r: r["start_char"])
    assert [r["sentence"] for r in rows] == units
    assert all(text[r["start_char"] : r["end_char"]] == r["sentence"] for r in rows)


TEXTS = [
    None, "", "  \n\t ", "　\xa0", "One.\n\nTwo", "Heading\n \nText here. More", "One.\r\n\r\nTwo.\rThree.", "no end", "...", "?!", "。。。", '"', '"open. And more', "“a. b", "(a. b", "a. b)", "🙂. 👩‍🌾! x", ". Two.", "a.B. c", "x" * 100_000, "Word one. " * 20_000, "(" * 3000 + "a.", '"' * 3001 + " a.", "ก" * 5000 + " " + "ข" * 5000, "。" * 5000, "A" + "́" * 500 + ". B.",
]


def test_all_other_characters_lie_in_exactly_one_unit(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    by = {}
    for r in split_sentences(df, "text", ["doc_id"]).collect():
        by.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"], r["sentence"]))
    for i, text in enumerate(TEXTS):
        at = 0
        for start, end, sentence in sorted(by.get(i, [])):
            assert at <= start < end and text[start:end] == sentence == sentence.strip()
            assert not text[at:start].strip()
            at = end
        assert not (text or "")[at:].strip()
    assert [s for *_, s in sorted(by[5])] == ["Heading", "Text here.", "More"]
    assert [s for *_, s in sorted(by[6])] == ["One.", "Two.", "Three."]
    assert len(by[20]) == 20_000
    assert split_sentences(df.limit(0), "text", ["doc_id"]).count() == 0


def test_texts_that_hold_placeholders(spark):
    text = "Ab. C  d? “E. F!” says g."
    rows = split_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", ["doc_id"]).collect()
    assert [r["sentence"] for r in sorted(rows)] == ["Ab.", "C  d?", "“E. F!” says g."]


def units_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [[] for _ in texts]
    for r in split_sentences(df, "text", ["doc_id"]).collect():
        out[r["doc_id"]].append((r["start_char"], r["sentence"]))
    return [[s for _, s in sorted(x)] for x in out]


def test_no_number_of_things_changes_a_rule(spark):
    many = "'" + "It's. " * 200 + "so' he said. Next."
    thai = "นี่คือบ้านของเรา " + "และสวนของเราอยู่ข้างบ้าน " * 150 + "เมื่อวานนี้ฝนตกหนักมากทั้งวันทั้งคืน"
    brackets = "A (" + "b. " * 3000 + ") c. Next."
    got = units_of(spark, many, thai, brackets, "«" + "Oui. " * 5000 + "» dit-il. Fin.")
    assert got[0] == [many[:-6], "Next."]
    assert got[1] == [thai.rpartition(" ")[0], thai.rpartition(" ")[2]]
    assert got[2] == [brackets[:-6], "Next."]
    assert len(got[3]) == 2


def test_work_is_in_proportion_to_the_text(spark):
    parts = ["One is here. ", "ก" * 30 + " และ" + "ข" * 10 + " ", "'tis don't ", "“a. ", "(b. ", "J. K. ", "老桥...", "x? "]
    took = {}
    for size in (4_000, 32_000):
        began = time.time()
        units_of(spark, *[p * (size // len(p)) * 8 for p in parts])
        took[size] = time.time() - began
    assert took[32_000] < 8 * 3 * max(took[4_000], 1.0), took
