import pytest

from tidewright.llm.mojibake import repaired, restore

TEXT = "Le modèle dépend d’une “idée” naïve — façade à 5 € près de Göteborg."
RUSSIAN = "Следовательно, гладкая мера определена. Пусть решётка устойчива."


def garble(text: str, real: str, wrong: str, errors: str = "strict") -> str:
    out = []
    for b in text.encode(real, "replace"):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append("�" if errors == "replace" else chr(b))
    return "".join(out)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437"])
def test_utf8_read_as_a_legacy_page_comes_back(page):
    for text in (TEXT, RUSSIAN, "Zażółć gęślą jaźń, część główna"):
        back, spans, _ = restore(garble(text, "utf-8", page))
        assert spans and (back == text or page in ("cp1251", "mac_roman", "cp437")), (page, back)


def test_twice_over_and_lost_bytes():
    twice = garble(garble(TEXT, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restore(twice)[0] == TEXT
    lost = garble("Á la “carte”", "utf-8", "cp1252", "replace")
    assert "�" in lost and restore(lost)[1]


@pytest.mark.parametrize("text,real,wrong", [(RUSSIAN, "cp1251", "cp1252"), (RUSSIAN, "koi8_r", "cp1251"), ("Bröetti’s naïve façade, Sølby", "cp1252", "cp1251"), ("Oréworth’s naïve façade by Lüdmann", "cp1252", "mac_roman")])
def test_single_byte_pages_come_back(text, real, wrong):
    back, spans, _ = restore(garble(text, real, wrong))
    assert spans and back == text


SCRIPTS = {
    "arabic": "السلام عليكم، كيف حالك؟", "vietnamese": "Tiếng Việt rất đẹp, phải không?", "romanian": "Bucureşti și țară în București", "emoji": "well done 😀 👍 ok", "greek": "Ελληνική γλώσσα",
    "formula": "where α = β + γ", "chinese": "中文文字處理", "hebrew": "שלום עולם", "turkish": "İstanbul’da yapılan görüşme", "signs": "x ≤ y − 2, ∑ a → ∞", "japanese": "日本語のテキストです。", "korean": "한국어 문장",
}


@pytest.mark.parametrize("name", sorted(SCRIPTS))
def test_any_script_read_as_a_western_page_comes_back(name):
    text = SCRIPTS[name]
    assert restore(text) == (text, 0, "")
    for page in ("cp1252", "mac_roman"):
        back, spans, _ = restore(garble(text, "utf-8", page))
        assert spans and (back == text or page == "mac_roman"), (page, back)


@pytest.mark.parametrize("page", ["cp1252", "cp1251", "mac_roman", "cp1250", "cp437", "cp850", "cp866", "koi8_r"])
def test_long_spans_come_back_from_every_page(page):
    for name in ("arabic", "greek", "chinese", "hebrew", "japanese"):
        assert restore(garble(SCRIPTS[name], "utf-8", page))[0] == SCRIPTS[name]
    assert restore(garble(RUSSIAN, "utf-8", page))[0] == RUSSIAN


def test_only_the_quoted_part_of_a_line_is_exempt():
    line = garble(RUSSIAN, "cp1251", "cp1252")
    back, spans, _ = restore(f"\\verb|Ã©| {line} \\verb|{line}|")
    assert spans and back == f"\\verb|Ã©| {RUSSIAN} \\verb|{line}|"


def test_garbled_four_times_over():
    text = "é"
    for _ in range(4):
        text = garble(text, "utf-8", "cp1252")
    assert restore(f"caf{text} noir")[0] == "café noir"


@pytest.mark.parametrize(
    "text",
    [
        "«été» naïveté’” café”…", "НЕВИНОВЕН «Ёлка» Її їжак ЇЖАК Україна ВЇ", "STRÓŻ WĘŻÓW ŻÓŁW KSIĘŻNA", "╔═╗║ ┌─┬┐ └─┤", "2√π + ∆π ≤ ¬∂", "« L’été »: „Österreich“ ‚Öl‘", "Þórður veðátt góðæri", "Љубав Њујорк ЏЕЗ ЊЕГОШ",
        "Größe: „Übergang“ – ‘é’ “é” ”é", "Ελληνικά «Άλφα» Ώρα", TEXT, RUSSIAN, "Café naïve, решётка", "as organic as Ã—a nasal vowel—suggests", "├── data\n│   └── x.csv\n└── README", "A Γ-limit and √7 × ½ cost £303",
        "The names Плотва and SÃO VALDÃO and Ñuñal, Мера-Юг", "\\verb|Ã¼|", "«СССР» и Гёте, «Её» — ВУЗ", "L’écart, l’état d’âme", "ATENÇÃO À variação", "Größe „Übergang“ ß", "¿Qué será? ¡Sí, país!", "", "plain", None,
        "НЕРАВЕНСТВО ВЫПОЛНЕНО ДЛЯ ЛЮБОЙ ТОЧКИ", "Žižek, Łódź, Kraków, Český", "a" * 100_000,
    ],
)
def test_right_text_is_left_alone(text):
    assert restore(text) == (text, 0, "")


def test_one_line_among_right_ones_and_quoted_garble():
    doc = f"{TEXT}\n{garble('Göteborg é', 'utf-8', 'cp1252')}\n\\verb|Ã©| é"
    back, spans, pages = restore(doc)
    assert back == f"{TEXT}\nGöteborg é\n\\verb|Ã©| é" and spans == 2 and pages == "utf_8>cp1252"


def test_rows(spark):
    rows = [(1, TEXT), (2, garble(TEXT, "utf-8", "cp1252")), (2, garble(TEXT, "utf-8", "cp1252")), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as spans", "2 as restored")
    out = repaired(df).collect()
    assert [r["doc_id"] for r in out] == [2, 2] and out[0]["restored"] == TEXT
    assert repaired(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("page", ["cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp866", "koi8_r"])
def test_a_page_that_is_proven_decodes_the_rest_of_its_text(page):
    text = f"{RUSSIAN}\n«В разделе» — ¿Qué? „Näherung“, L’été 5 ± 2 °C\n├── data │\n{TEXT}"
    assert restore(garble(text, "utf-8", page))[0] == text
