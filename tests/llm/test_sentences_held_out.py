"""Units of everyday texts in eleven languages, written for this test: words, names and verbs are of no generator."""

import pytest

from tidelog.llm.sentences import split_sentences

#: Paragraphs of units; the units of a paragraph are joined by a space (by nothing in Chinese and Japanese).
TEXTS = {
    "en": [
        ["She lives in the U.S. and works for the Dept. of State.", "He moved there on Jan. 5, 2019.", "They met at approx. 7 p.m. in St. Louis."],
        ["He got an A.", "Then he left the room.", "Nobody had seen Mrs. Hopkins since Oct. 3.", "See Eq. 5, Sec. 3 and Vol. II for details."],
        ["The price fell to $3.50 per lb. in May.", "Why did it fall?", "Prof. J. K. Rowe had no answer!", "Visit www.example.org/faq.html or write to a.b@example.com."],
        ["“I don't know. Ask Sam,” she replied.", "He said, “Wait here. I'll be back.”", "Version 2.0.1 shipped today.", "It was 10.5 km away (cf. p. 12), i.e. too far."],
        ["She lives in the U.S.", "He lives in Canada.", "We read Smith et al. with care.", "The end was near…", "Or so they thought."],
        ["Is this No. 9?", "No, it's No. 10.", "Dr. Who came, saw, etc., and left.", "At 5 a.m. the bus from Washington D.C. arrived."],
    ],
    "de": [
        ["Im 19. Jahrhundert lebten hier 3.000 Menschen.", "Die 2. Auflage erschien 1987.", "Danach kam der Krieg.", "Am 3. Oktober wird gefeiert."],
        ["Dr. Hans Meier wohnt in der Goethestr. 5 in Köln.", "Er zahlt ca. 800 Euro, d. h. zu viel.", "Warum eigentlich?", "Vgl. dazu Bd. 3, S. 44 und Abb. 2."],
        ["„Komm rein. Setz dich!“, rief die Oma.", "Sie antwortete: „Gern. Danke.“", "Das Paket wiegt 2,5 kg bzw. 2.500 g.", "Prof. Krause kam um 8.30 Uhr."],
        ["Die Firma Müller GmbH baut z. B. Möbel, Fenster usw.", "Heute ist der 1. Mai.", "Er wurde 1990.", "Das war alles."],
        ["Wir treffen uns am 12. Jan. um neun.", "Ludwig XIV. war König von Frankreich.", "Toll!", "Die Seite www.beispiel.de ist weg."],
        ["Der Zug hält u. a. in Ulm.", "Ob er kommt?", "Das weiß niemand…", "Der 4. Versuch gelang, der fünfte auch."],
    ],
    "fr": [
        ["M. Dupont habite au 3, rue St. Paul.", "Il est né le 4 janv. 1950.", "Mme Leroy, elle, vient de Lyon.", "Qui l'eût cru ?"],
        ["« Entrez. Asseyez-vous ! » dit le médecin.", "Elle répondit : « Merci. »", "Le prix est de 3.50 euros.", "C'est cher, p. ex. pour un étudiant."],
        ["Voir vol. 2, p. 15 et fig. 3.", "Ah non !", "La réunion est fixée au 12 déc. 2020.", "Personne n'est venu."],
        ["Le Dr. Martin a écrit à J. P. Moreau.", "Ensuite, il a attendu…", "Puis rien.", "On vend du pain, du lait, etc., au marché."],
        ["Consultez www.exemple.fr pour plus d'infos.", "Est-ce vrai ?", "Oui, c.-à-d. presque.", "Cela coûte env. 40 francs."],
    ],
    "es": [
        ["El Sr. Pérez vive en la Av. Bolívar.", "Nació el 5 de ene. de 1960.", "¿Quién lo sabe?", "¡Nadie!"],
        ["La Dra. Gómez trabaja en EE. UU. desde 1999.", "Ella gana 3.500 euros al mes.", "Véase pág. 14, fig. 2 y cap. 3.", "Eso dijo Ud. ayer."],
        ["«Pase. Siéntese», dijo el juez.", "Él contestó: «Gracias. Ya me voy.»", "Llegó a las 5 p. m. del lunes.", "Luego llovió…"],
        ["Hay fruta, p. ej. peras, y pan.", "Pero no hay queso.", "Visite www.ejemplo.es hoy.", "La versión 1.2 falla."],
        ["Compró leche, huevos, etc.", "Después volvió a casa.", "¿Cuánto mide, aprox. dos metros?", "Todos rieron."],
    ],
    "ru": [
        ["Он родился 5 янв. 1950 г. в Москве.", "Она живёт на ул. Ленина.", "Проф. Сидоров читает лекции.", "Когда он придёт?"],
        ["«Входите. Садитесь!» — сказал врач.", "Она ответила: «Спасибо. Я постою.»", "Цена выросла до 3.5 тыс. руб. за тонну.", "Это много!"],
        ["См. рис. 3, стр. 15 и т. 2.", "А. С. Пушкин умер в 1837 году.", "Потом наступила тишина…", "Никто не спорил."],
        ["Они продают хлеб, молоко и т. д.", "Завтра будет дождь, т. е. мы останемся дома.", "Сайт www.primer.ru не работает.", "Кто знает?"],
        ["Гл. 5 начинается на стр. 80.", "Мы купили 20 кг. яблок.", "Но и этого мало.", "Всё."],
    ],
    "zh": [
        ["今天天气很好。", "我们去公园吧！", "你觉得怎么样？", "价格是3.5元。"],
        ["老师说：“请坐。开始上课！”", "他问：“几点了？”", "现在是上午8点。", "“好的。”她点头说。"],
        ["这本书（见第3章。）很有趣。", "版本2.0.1已发布。", "网址是www.example.cn。", "真的吗？！"],
        ["他走了……", "没有人知道他去了哪里。", "Dr. Wang来自北京大学。", "小王喜欢《红楼梦》。"],
        ["人口约为1.4亿。", "雨停了；太阳出来了。", "快跑！", "为什么不呢？"],
    ],
    "ja": [
        ["今日はいい天気です。", "公園に行きましょう！", "どう思いますか？", "値段は3.5ドルです。"],
        ["先生は「座ってください。始めます。」と言いました。", "「何時ですか？」と彼は聞いた。", "今は午前8時です。", "バージョン2.0が出た。"],
        ["この本（第3章。参照）は面白い。", "彼は行ってしまった……", "誰も知らない。", "本当ですか？！"],
        ["Mr. Satoは東京に住んでいます。", "住所はwww.example.jpです。", "雨がやんだ。", "なぜ？"],
        ["人口は約1.2億人です。", "走れ！", "『坊っちゃん』を読みました。", "明日も来ますか。"],
    ],
    "ar": [
        ["ولد في القاهرة عام 1950.", "أين يعيش الآن؟", "يعمل د. سامي في المستشفى.", "يا له من يوم!"],
        ["السعر 3.5 دولار.", "قال المعلم: «اجلسوا. سنبدأ الآن.»", "سألت أمي: «كم الساعة؟»", "لا أحد يعرف."],
        ["انظر ص. 15 من الكتاب.", "هذا صحيح، أليس كذلك؟", "نعم!", "وصل القطار متأخرا."],
        ["زار أ. محمود المدينة أمس.", "الموقع هو www.example.com اليوم.", "انتهى الدرس.", "متى نعود؟"],
        ["اشترى الخبز والحليب إلخ.", "الإصدار 2.1 جديد.", "كان الجو باردا (انظر الجدول. إنه قديم.) جدا.", "شكرا."],
    ],
    "hi": [
        ["आज मौसम अच्छा है।", "हम बाज़ार जाएँगे।", "क्या आप आएँगे?", "बहुत बढ़िया!"],
        ["डॉ. शर्मा दिल्ली में रहते हैं।", "कीमत 3.5 रुपये है।", "गुरु ने कहा, “बैठो। पढ़ाई शुरू करो।”", "वह चला गया।"],
        ["पृ. 15 देखिए।", "यह किसने लिखा?", "श्री वर्मा ने लिखा।", "वेबसाइट www.example.in बंद है।"],
        ["बारिश रुक गई।", "बच्चे (कक्षा 3 के। वे छोटे हैं।) खेल रहे हैं।", "संस्करण 2.0 आ गया।", "कब?"],
        ["पं. नेहरू पहले प्रधानमंत्री थे।", "उन्होंने किताब लिखी।", "“रुको। सुनो!” माँ बोली।", "सब चुप थे।"],
    ],
    "el": [
        ["Γεννήθηκε στις 5 Ιαν. 1950.", "Πού μένει τώρα;", "Ο κ. Παπαδόπουλος δουλεύει εδώ.", "Τι ωραία μέρα!"],
        ["Η τιμή είναι 3.5 ευρώ.", "«Ελάτε. Καθίστε!» είπε ο γιατρός.", "Εκείνη απάντησε: «Ευχαριστώ. Φεύγω.»", "Κανείς δεν μίλησε."],
        ["Βλ. σελ. 15 και εικ. 2.", "Πουλάει φρούτα, π.χ. μήλα.", "Ήρθε στις 8 π.μ. τη Δευτέρα.", "Γιατί όχι;"],
        ["Ο Δρ. Νίκου έγραψε το βιβλίο.", "Μετά έφυγε…", "Όλοι γέλασαν.", "Η σελίδα www.example.gr δεν ανοίγει."],
        ["Αγόρασε ψωμί, γάλα κ.λπ.", "Αύριο θα βρέξει.", "Η έκδοση 2.0 βγήκε.", "Ποιος ξέρει;"],
    ],
    "th": [
        ["วันนี้อากาศดีมากค่ะ", "คุณจะไปเที่ยวไหนคะ", "ฉันอยากไปเที่ยวทะเลกับครอบครัวของฉัน", "พ่อของฉันทำงานอยู่ที่โรงพยาบาลในกรุงเทพ"],
        ["ราคาสินค้าคือ 3.5 บาทต่อชิ้นครับ", "ใครเป็นคนเขียนหนังสือเล่มนี้?", "นักเรียนทุกคนต้องมาโรงเรียนแต่เช้า เพราะมีสอบวันนี้", "เมื่อวานนี้ฝนตกหนักมากทั้งวันทั้งคืน"],
        ["“ฝนตกแล้ว! รีบกลับบ้านกันเถอะ!” แม่กล่าว", "เด็กๆวิ่งเล่นอยู่ในสนามหน้าโรงเรียนอย่างสนุกสนาน", "“พรุ่งนี้คุณจะมาไหม?” ครูถาม", "นักท่องเที่ยวเดินทางมาจากหลายประเทศทั่วโลก"],
        ["เขาเกิดเมื่อวันที่ 5 ม.ค. ที่เชียงใหม่ครับ", "ดร. สมชายสอนหนังสืออยู่ที่มหาวิทยาลัยแห่งหนึ่งในกรุงเทพ", "รถไฟขบวนสุดท้ายออกจากสถานีตอนสี่ทุ่ม", "คุณเห็นด้วยหรือเปล่า"],
        ["เขาตอบว่า “ขอบคุณครับ ผมจะรอ”", "แมวของฉันชอบนอนหลับอยู่บนโซฟาทั้งวัน", "ร้านอาหารแห่งนี้ขายก๋วยเตี๋ยว ข้าวผัด ฯลฯ", "นี่คือบ้านหลังใหม่ของเราที่เพิ่งสร้างเสร็จ"],
    ],
}


@pytest.fixture(scope="module")
def found(spark):
    rows, want = [], {}
    for lang, paragraphs in TEXTS.items():
        for n, units in enumerate(paragraphs):
            text = ("" if lang in ("zh", "ja") else " ").join(units)
            at, spans = 0, set()
            for u in units:
                start = text.index(u, at)
                at = start + len(u)
                spans.add((start, at))
            rows.append((f"{lang}-{n}", text))
            want[f"{lang}-{n}"] = (text, spans)
    df = split_sentences(spark.createDataFrame(rows, "doc_id string, text string"), "text", ["doc_id"])
    got: dict[str, set] = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], set()).add((r["start_char"], r["end_char"]))
    return want, got


@pytest.mark.parametrize("lang", TEXTS)
def test_recall_and_precision(found, lang):
    want, got = found
    keys = [k for k in want if k.startswith(lang + "-")]
    hit = sum(len(want[k][1] & got[k]) for k in keys)
    n_want, n_got = sum(len(want[k][1]) for k in keys), sum(len(got[k]) for k in keys)
    assert n_want >= 20
    wrong = [want[k][0][a:b] for k in keys for a, b in sorted(got[k] - want[k][1])]
    assert hit / n_want >= 0.95 and hit / n_got >= 0.95, (hit, n_want, n_got, wrong)
