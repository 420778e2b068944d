"""Spam pages and what only looks like them."""

import numpy as np
import pytest

from gristmill.llm import stuffing as S
from tests.conftest import same_rows

SENTENCE = "The decision was recorded after the second walk through the module, and nobody asked for more. "
WORDS = ["cheap", "best", "top", "online", "free"]
YES = [
    ", ".join(f"{w} tariff review {x}" for w in WORDS for x in ("tool", "vendor", "software")), "\n".join(f"loyalty review {x} Larkford" for x in ("tool", "vendor", "course", "pricing") * 6),
    " ".join(["mapping", "vendor", "report", "scanner"] * 30).upper(), "#tariff #loyaltyreview " * 20, "\n".join(f"- https://shop{i}.example/p/{i * 7}" for i in range(20)),
    "Looking for tariff review tool? Get tariff review tool near you. Our tariff review tool is the tariff review tool that every tariff review tool buyer wants. " * 4,
    "\n".join(f"SKU Tool-{i} ${i}5.99 | in stock | tariff, claim, audit" for i in range(15)), SENTENCE + ", ".join(f"{w} claim diagram {x}" for w in WORDS for x in ("tool", "vendor", "course", "service", "scanner")),
    "lantern, granite, copper, meadow, orchid, juniper, timber, hafen, riviera, cobalt, bosque, velvet, saffron, marble, winter, harbor",
]
NO = [
    None, "", " \n\t ", SENTENCE * 8, "Es gab zwei Kandidaten, deshalb wurde keine Kante gezeichnet. " * 6, "このノードの信頼度は 82 です。レビューが必要です。" * 5, "Η απόφαση καταγράφηκε μετά τον δεύτερο έλεγχο. " * 6,
    "unit | kind | confidence\n--- | --- | ---\n" + "\n".join(f"a-{i} | service | {i}" for i in range(20)), "\n".join(f"2026-01-01T00:00:{i:02d}Z INFO [svc] unit {i} kept" for i in range(30)), "\n".join(["  port: 80", "  replicas: 2", "# worker", "a.topic=b"] * 10),
    "\n".join(f"import {{ X{i} }} from './x{i}';\n  async find{i}(id: number) {{\n    return this.repo.load(id, {i});\n  }}" for i in range(10)), "Changelog\n" + "\n".join(f"1.{i}.0 - Fixed: {SENTENCE}(#{i})" for i in range(8)),
    "\n".join(f"- [Unit {i}](https://docs.example/{i}): {SENTENCE}" for i in range(8)), "\n".join(f"GET /x/{i} - {SENTENCE}" for i in range(8)), "\n".join(f"term{i}: {SENTENCE}" for i in range(8)),
    SENTENCE * 9 + "\n#tariff #claim #audit #review #tool", SENTENCE * 8 + "\nReferences:\n- https://a.example/1\n- https://a.example/2",
]


PROSE = {
    "fi": "Vanha kaupungin kirjasto avasi ovensa eilen aamulla kello kahdeksan ja ensimmäiset lukijat saapuivat heti hakemaan varaamiaan teoksia joita oli odotettu koko pitkän kesän ajan ilman että kukaan osasi sanoa milloin remontti lopulta valmistuisi",
    "tr": "Şehrin eski kütüphanesi dün sabah saat sekizde kapılarını yeniden açtı ve ilk okurlar aylardır bekledikleri kitapları almak için hemen içeri girdiler çünkü onarımın ne zaman biteceğini kimse tam olarak bilmiyordu",
    "cs": "Stará městská knihovna včera ráno v osm hodin znovu otevřela své dveře a první čtenáři si hned přišli vyzvednout knihy které si objednali už během dlouhého léta kdy nikdo nevěděl kdy oprava konečně skončí",
    "ar": "فتحت مكتبة المدينة القديمة أبوابها صباح أمس في الساعة الثامنة ودخل القراء الأوائل فورا لاستلام الكتب التي طلبوها طوال الصيف الطويل دون أن يعرف أحد متى تنتهي أعمال الترميم",
    "hi": "शहर का पुराना पुस्तकालय कल सुबह आठ बजे फिर से खुल गया और पहले पाठक तुरंत अपनी किताबें लेने आ गए जिनका वे पूरी लंबी गर्मी भर इंतजार करते रहे जबकि किसी को पता नहीं था कि मरम्मत कब खत्म होगी",
    "sv": "Stadens gamla bibliotek öppnade sina dörrar igen klockan åtta i går morse och de första läsarna kom genast in för att hämta böckerna som de hade beställt under den långa sommaren utan att någon visste när renoveringen skulle bli klar",
    "ko": "도시의 오래된 도서관이 어제 아침 여덟 시에 다시 문을 열었고 첫 독자들은 긴 여름 내내 기다려 온 책을 받으러 곧바로 들어왔지만 수리가 언제 끝날지는 아무도 몰랐다",
}
KEYWORDS = {"fi": ["halpa", "kirja", "kauppa", "netti", "alennus"], "ko": ["저렴한", "도서", "쇼핑", "무료", "할인"], "ar": ["كتب", "رخيصة", "تسوق", "مجانا", "عروض"], "ja": ["格安", "書籍", "通販", "無料", "割引"]}


@pytest.mark.parametrize("lang", PROSE)
def test_prose_in_a_language_without_listed_words_is_no_spam(lang):
    for text in (PROSE[lang], f"{PROSE[lang]}. {PROSE[lang]}.", (PROSE[lang] + ". ") * 6, SENTENCE + PROSE[lang] + "."):
        assert S.analyse(text)["spam"] <= S.THRESHOLD and S.analyse(text, full=False)["spam"] <= S.THRESHOLD


@pytest.mark.parametrize("lang", KEYWORDS)
def test_keywords_in_such_a_language_are_found(lang):
    w = KEYWORDS[lang]
    assert S.analyse(", ".join(f"{a} {b}" for a in w for b in w))["spam"] > S.THRESHOLD


def test_links_tags_and_prices_count_only_where_they_recur():
    assert S.analyse("- https://a.example/1")["spam"] == 0.0 and S.analyse("#tariff")["spam"] == 0.0
    alone = S.analyse("image: registry | 7.70 | x\n" + SENTENCE)
    assert alone["product"] == 0.0
    far = SENTENCE * 3
    assert S.analyse(f"{far}\n- https://a.example/1\n{far}\n- https://a.example/2\n{far}")["link"] == 0.0
    assert S.analyse("- https://a.example/1\n- https://a.example/2\n- https://a.example/3")["link"] == 1.0
    kinds = [x.kind for x in S.read_lines("unit | kind | n\n--- | --- spoilt | ---\na | service | 1\n\nbroken\nb | service | 2\nc, d ---===***=== | e | f $5")]
    assert kinds == ["neutral"] * 6
    assert S.read_lines("x - $155 ---===***===--- | in stock | claim, audit\ny - $3 | in stock | c")[0].kind == "product"


@pytest.mark.parametrize("text", YES)
def test_spam(text):
    assert S.analyse(text)["spam"] > S.THRESHOLD


@pytest.mark.parametrize("text", NO)
def test_no_spam(text):
    assert S.analyse(text)["spam"] <= 0.35


def test_gaps_and_autocorrelation():
    terms = np.array([1, 2, 1, 3, 2, 1])
    assert S.recurrence_gaps(terms).tolist() == [2, 3, 2, 1 << 30, 3, 3]
    peak, local = S.autocorrelation(np.array([0, 1, 2] * 20), np.ones(60, bool), S._bounds(60))
    assert peak == 1.0 and local.max() == 1.0
    long = np.arange(30_000) % 4
    assert S.autocorrelation(long, np.ones(30_000, bool), S._bounds(30_000))[0] == 1.0


def test_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate(YES + NO)] + [(0, YES[0], "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spam string")
    same_rows(S.find_stuffed(df).collect(), [(i,) for i in range(len(YES))])
    assert S.find_stuffed(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, SENTENCE * 5000), (2, YES[0] * 300)], "doc_id bigint, text string")
    same_rows(S.find_stuffed(long).collect(), [(2,)])


def test_long_lines_take_no_long_time():
    import time

    t = time.time()
    for text in ("|" + "-" * 20_000 + "| x", "(" * 5000 + "x", "a(" * 20_000, "{ " * 20_000 + "x", "https://" * 5000):
        S.analyse(text)
    assert time.time() - t < 30
