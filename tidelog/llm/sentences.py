r"""Sentence boundaries across languages and scripts, in SQL expressions only.

The text is never changed in length while boundaries are sought, so positions in it stay those of the original:

1. dots and marks that don't end a sentence (decimals, versions, file and host names, URLs, initials, abbreviations,
   dates, marks inside brackets, continuing ellipses) are masked by private-use placeholders, one per character;
2. quotations are found as spans; the marks in them are masked too. A quotation that opens a sentence is followed by the
   words that report it, one that follows them ends the sentence if it ends with a mark;
3. terminators of every script (Latin, Greek, Cyrillic, Arabic, Devanagari, CJK), and for Thai the spaces between
   statements, get a boundary sign behind them; a blank line always gets one;
4. the text is cut at the signs, the lengths of the pieces give the positions, and the positions give back the original
   characters.

Rules go by the characters found, never by the language label. Placeholders that a text already holds count as letters.
Every pattern is tried only on texts that hold a character it needs, and no pattern has a limit on lengths that makes work
more than proportional: runs are possessive and unbounded.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders (private use): one for each mark, so that they can be turned back; a sign for blank lines; signs that are
# put between characters.
MARKS = ".!?。！？।॥؟…;｡． "
MASKED = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
DOT, ASK, ELL, SPACE = (MASKED[MARKS.index(c)] for c in ".?… ")
BLANK, OPEN, CLOSE, CUT = "\ue0f0", "\ue0f1", "\ue0f2", "\ue0f3"
PLACEHOLDERS = MASKED + BLANK + OPEN + CLOSE + CUT

WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" + BLANK
CLOSERS = "\"'”’»›)\\]）】」』〉》"

# Abbreviations with a dot after which a sentence goes on.
TITLES = (
    "Mr Mrs Ms Messrs Dr Prof Rev Hon Capt Cpt Col Gen Lt Maj Sgt Sen Rep Gov St Ste Mt Ft Jr Sr Sra Srta Dra Ud Uds Vd Vds "
    "M MM Mme Mmes Mlle Mlles Mgr Pr Hr Fr Frl Dipl Ing Dipl.-Ing Nn Акад Проф Доц Инж Св Им Д-р Г-н Г-жа К Κ Κα Κος Δρ Καθ "
    "κ κα κκ डॉ पं प्रो श्री सुश्री द أ د م ดร นาย "
    "Av Avda Pza Pje ул пер просп пл наб обл пос"
).split()
CONNECTORS = (
    "e.g i.e cf viz vs approx ca circa resp incl esp al bzw vgl z.B u.a d.h o.ä s.o s.u sog ggf evtl inkl zzgl "
    "p.ex c.-à-d c-à-d p.ej aprox т.е напр ок см ср т.н т.к π.χ δηλ περ βλ उदा"
).split() + ["z. B", "u. a", "d. h", "p. ex", "p. ej", "т. е", "т. н", "т. к", "π. χ"]
# Abbreviations that only count as such before a number (or a Roman one), by language.
NUMBERED = (
    "No Nos no nos Vol Vols vol vols Fig Figs fig figs Eq Eqs eq eqs Sec Secs sec secs Sect Ch Chs ch Chap Chaps chap Pt Pts pt Para Paras para Tab App Bk Art Arts art Ex Ref Refs Ser Ed Op op p pp P "
    "Nr Nrn Abb Kap Bd Bde S Abs Ziff Tab Anm Aufl Jg Bl Rz Str "
    "n nº núm num art cap sec tít pág págs fol t éd sect al "
    "стр с рис гл п пп табл т № ст ч разд вып ред "
    "σελ σ αρ αριθ εικ κεφ άρθ παρ τόμ πίν τ "
    "ص ج ط رقم "
    "क्र पृ अंक सं खं ข้อ หน้า"
).split()
# Names of months, short, by language. They may end a sentence, but not before a number.
SHORT_MONTHS = (
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Jän Febr Mär Okt Dez janv févr avr juil sept oct nov déc ene abr ago dic "
    "янв февр фев мар апр авг сент сен окт нояб ноя дек Ιαν Φεβ Μαρ Απρ Μαΐ Ιουν Ιουλ Αυγ Σεπ Σεπτ Οκτ Νοε Δεκ जन फ़र अग सित अक्टू नव दिस"
).split()
# Abbreviations that may end a sentence; they do unless what follows goes on with it.
ENDING = (
    "env etc usw u.s.w uswf ff Inc Co Corp Ltd Bros Cía Cia S.A GmbH a.m p.m A.D B.C и пр пр и др др т.д т. д т.п т. п тыс млн млрд руб коп гг вв "
    "κ.λπ κ.ά π.μ μ.μ κτλ κλπ إلخ พ.ค ม.ค ก.พ มี.ค เม.ย มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค ฯลฯ"
).split() + ["a. m", "p. m", "и т. д", "и т. п", "u. Ä", "κ. ά"]
# Units behind a number; they may end a sentence as well.
UNITS = "h hrs min mins sec kg km cm mm lb lbs oz ft in Std Min мин час км кг см м ώρ χλμ".split()
# Names of months, long and short, that follow an ordinal number with a dot.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Jän Febr Feb Mär Apr Jun Jul Aug Sept Sep Okt Nov Dez".split()
# German words before an ordinal number.
BEFORE_ORDINAL = "der die das den dem des im am vom zum zur beim ins ans ein eine einen einem einer eines jeder jede jedes jeden jedem seit bis ab und oder unser unsere unserem ihr ihre ihrem sein seine seinem mein meine meinem dieser diese dieses diesem diesen".split()
# Function words that begin a sentence and are no surnames. Before one of them a single letter, a number or an
# abbreviation that could go on ends the sentence after all.
STARTERS = (
    "The He She It They We You Then This That These Those There But And So Or When While After Before If In On At His Her Their My Our Its What Why How Who Where Which Now Here Yes Later However Nobody Everyone Everybody Someone Nothing Today Yesterday Tomorrow Both Each Many Most Some All One Is Are Was Were Did Does Do Can Will "
    "Er Sie Es Wir Ihr Ich Dann Das Der Die Dies Diese Dieser Dieses Aber Und Oder Doch Da Dort Hier Wenn Als Nach Vor Im Am In Auf Bei Sein Seine Ihre Mein Meine Unser Unsere Was Warum Wie Wer Wo Jetzt Heute Gestern Morgen Niemand Jeder Alle Viele Ein Eine Danach Später Ist War Hat "
    "Il Elle Ils Elles On Nous Vous Je Tu Ce Cela Ça Mais Et Ou Puis Alors Donc Quand Si Après Avant Son Sa Ses Leur Leurs Mon Ma Mes Notre Que Pourquoi Comment Qui Où Aujourd Hier Demain Personne Chacun Une Ensuite "
    "Él Ella Ellos Ellas Nosotros Yo Tú Usted Esto Eso Este Esta Pero Y O Luego Entonces Cuando Después Antes Su Sus Mi Mis Nuestro Qué Cómo Quién Dónde Ahora Hoy Ayer Mañana Nadie Todos Una Aquí Allí Ya "
    "Он Она Оно Они Мы Вы Ты Это Этот Эта Эти Но А И Или Потом Затем Когда Если После До В На Его Её Их Мой Моя Наш Что Почему Как Кто Где Сейчас Здесь Там Сегодня Вчера Завтра Никто Все Каждый "
    "Αυτός Αυτή Αυτό Αυτοί Εμείς Εγώ Εσύ Αλλά Και Ή Μετά Τότε Όταν Αν Πριν Ο Η Το Οι Τα Στο Στη Στην Τι Γιατί Πώς Ποιος Πού Τώρα Εδώ Εκεί Σήμερα Χθες Αύριο Κανείς Όλοι"
).split()

#: Thai, as a range, which is found faster than by its name.
THAI = r"\u0e00-\u0e7f"
LETTER = r"\p{L}\p{M}"
CASED = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}"
#: A small letter that goes on with a sentence; a word with a capital further on is a name and may start one.
SMALL = r"(?!\p{Ll}++\p{Lu})\p{Ll}"
NOT_IN_WORD = rf"(?<![{LETTER}\p{{N}}])"


def _alternatives(words: list[str]) -> str:
    """A pattern for any of the words, whose common beginnings are tried once."""

    def tree(words: set[str]) -> str:
        heads: dict[str, set[str]] = {}
        for w in words - {""}:
            heads.setdefault(w[0], set()).add(w[1:])
        sign = lambda c: rf"[.{DOT}]" if c == "." else r"[ \u00a0]" if c == " " else re.escape(c)
        parts = [sign(c) + tree(rest) for c, rest in sorted(heads.items())]
        if not parts:
            return ""
        one = "(?:" + "|".join(parts) + ")"
        return one + "?" if "" in words else one if len(parts) > 1 else parts[0]

    # composed and decomposed letters
    return tree({unicodedata.normalize(form, w) for w in words for form in ("NFC", "NFD")})


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def _mask_spans(text: Column, spans: str, first: str) -> Column:
    """Mask the marks inside every match of spans, which begins with a character of first; matches get OPEN and CLOSE around."""
    cut = F.split(_sub(text, f"({spans})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    inside = lambda x: F.concat(F.lit(OPEN), F.translate(x, MARKS, MASKED), F.lit(CLOSE))
    joined = F.array_join(F.transform(cut, lambda x, i: F.when(i % 2 == 1, inside(x)).otherwise(x)), "")
    return F.when(text.rlike(f"[{first}]"), joined).otherwise(text)


def _drop_signs(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))


#: A word that begins a sentence, behind white space.
STARTS = rf"[\s ]++{_alternatives([w for w in STARTERS if len(w) > 1])}(?![{LETTER}\p{{N}}.])"
Step = tuple[str, str, str]
_BEGINS = rf"(?:{NOT_IN_WORD}|(?<=[^{CASED}\p{{N}}\p{{IsInherited}}])(?=\p{{IsLatin}}))"


def _dot(before: str, then: str = "", flags: str = "") -> str:
    """What holds behind a dot that `then` follows and `before` precedes. What follows is looked at first: it costs less."""
    return rf"(?{flags}:{then}(?<=(?:{before})\.))"


def _dots() -> str:
    """A pattern for the dots that end nothing: of abbreviations, initials, dates, decimals and names. One pass tries all."""
    goes_on = rf"(?=\s*[^\s{BLANK}])(?!\s*{BLANK})"
    ending = _alternatives(ENDING)
    number = r"(?=\s{0,2}(?:\p{N}|[IVXLCDM]++(?![\p{L}\p{N}])))"
    kinds = [
        # abbreviations with inner dots and titles, before single dots are looked at
        _dot(rf"{NOT_IN_WORD}(?:e|i|p|z|u|d|s|o|т|π|κ|a|c|S)", rf"(?=[ \u00a0]?(?:g|e|ex|ej|m|B|a|h|ä|χ|λπ|ά|A|е|к|н|C|д|п)[.{DOT}])", "iu"),
        _dot(_BEGINS + _alternatives(TITLES + [w.upper() for w in TITLES]), goes_on, "u"),
        _dot(_BEGINS + _alternatives(CONNECTORS), goes_on, "iu"),
        rf"{number}(?<=(?:(?:{_BEGINS}(?iu:{_alternatives(NUMBERED)})|{NOT_IN_WORD}(?iu:{_alternatives(SHORT_MONTHS)})|\p{{Ll}}str|\p{{Ll}}\p{{Ll}}[  ]env)\.))",
        # initials and single letters, unless a word that begins a sentence follows; in scripts without spaces they may follow a letter of another script
        _dot(rf"(?<![{CASED}\p{{N}}])(?<![{CASED}]\p{{M}})(?<!\p{{N}}[ \u00a0])\p{{Lu}}\p{{M}}?(?<!(?iu:{NOT_IN_WORD}{ending}))", rf"(?=[ \u00a0]?[\r\n]{{0,2}}\p{{L}})(?!{STARTS})"),
        # plurals made by doubling letters
        _dot(rf"{NOT_IN_WORD}\p{{Lu}}\p{{Lu}}", r"(?=[  ]?(\p{Lu})\1\.)"),
        # abbreviations that may end a sentence, and don't here
        rf"(?=[ \u00a0]*[)\]]|\s{{1,2}}(?iu:{ending})\.)(?<=(?:(?:{NOT_IN_WORD}(?iu:{ending})|\p{{N}}[  ]?(?iu:{_alternatives(UNITS)}))\.))",
        r"(?=[ \u00a0]*[,;:])(?<=[\p{L}\p{M}\p{N}]\.)",
        # ordinal numbers: of dates, and between an article and a noun
        _dot(r"\p{N}", rf"(?=[ \u00a0](?:{'|'.join(MONTHS)})(?![{LETTER}]))"),
        _dot(rf"{NOT_IN_WORD}(?iu:{_alternatives(BEFORE_ORDINAL)})[  ]\p{{N}}{{1,3}}", rf"(?<=\p{{N}}\.)(?=[  ]\p{{Lu}})(?!{STARTS})"),
        # decimals, versions, file and host names: a dot between letters or digits, but not `word.Word` and not between words of other scripts
        r"(?:(?<=\p{N}\.)(?=[\p{L}\p{N}])|(?<=\p{L}\.)(?=\p{N}))",
        _dot(f"[{CASED}]", rf"(?=[{CASED}])(?!(?<=\p{{Ll}}\.)\p{{Lu}}[\p{{Ll}} ])"),
    ]
    return r"\.(?:" + "|".join(kinds) + ")"


#: What a step needs to be tried: characters of which a text must hold one. A step is (needs, pattern, replacement).
MASKS: list[Step] = [
    # the line break that begins a blank line
    ("\n\r", r"(?:\n|\r(?!\n))(?=[ \t\u000b\f\r\u00a0\u3000]*(?:\n|\r(?!\n)))", BLANK),
    # URLs and addresses: marks followed by more of them
    ("=", r"\?(?<=[A-Za-z0-9/=&_-]\?)(?=[A-Za-z0-9_%-]+=)", ASK),
    (".", _dots(), DOT),
    # Thai months
    ("พมกสตธ", r"\.(?<=(?:[พมกสตธ]|มี|เม|มิ)\.)(?=[คพยม]\.)", DOT),
    ("พมกสตธ", rf"\.(?<={DOT}[คพยม]\.)", DOT),
]


def _needed(text: Column, needs: str) -> Column:
    """Whether text holds one of the characters; searched as bytes, which costs next to nothing."""
    out = text.contains(needs[0])
    for c in needs[1:]:
        out = out | text.contains(c)
    return out


def _apply(rows: DataFrame, text: str, steps: list[Step]) -> DataFrame:
    """Replace step by step, each where it may find something."""
    for needs, pattern, to in steps:
        done = _sub(F.col(text), pattern, to)
        rows = rows.withColumn(text, F.when(_needed(F.col(text), needs), done).otherwise(F.col(text)) if needs else done)
    return rows


def with_masks(rows: DataFrame, text: str) -> DataFrame:
    """Step 1: everything masked that surely doesn't end a sentence, but for spans. Same length."""
    return _apply(rows, text, MASKS)


BRACKETS = rf"\([^(){BLANK}]*\)|（[^（）{BLANK}]*）|\[[^\[\]{BLANK}]*\]|【[^【】{BLANK}]*】"


QUOTES = "|".join([
    rf"“[^“”{BLANK}]*+”", rf"„[^„“”{BLANK}]*+[“”]", rf"«[^«»{BLANK}]*+»", rf"»[^«»{BLANK}]*+«", rf"「[^「」{BLANK}]*+」", rf"『[^『』{BLANK}]*+』", rf"‘(?=\S)[^‘’{BLANK}]*+(?:(?<=\p{{L}})’(?=\p{{L}})[^‘’{BLANK}]*+)*+’(?!\p{{L}})",
    rf'"(?<!(?:[^\s{BLANK}:：(（。！？।，、{LETTER}]|\p{{IsLatin}})")(?=\S)[^"{BLANK}]*+"', rf"'(?<![{LETTER}\p{{N}}]')(?=\S)[^'{BLANK}]*+(?:(?<=\p{{L}})'(?=\p{{L}})[^'{BLANK}]*+)*+'(?!\p{{L}})",
])


def with_spans(rows: DataFrame, text: str) -> DataFrame:
    """Step 2: marks in brackets and quotations masked, and a CUT behind the quotations that end their sentence."""
    c = F.col(text)
    rows = rows.withColumn(text, F.when(_needed(c, "(（[【"), _drop_signs(_mask_spans(c, BRACKETS, r"(（\[【"))).otherwise(c))
    # an ellipsis before a small letter goes on
    rows = _apply(rows, text, [(".", rf"\.\.\.(?=\s*{SMALL})", DOT * 3), ("…", rf"…(?=\s*{SMALL})", ELL)])
    ends = f"[{MASKED[:-1]}]"
    # reporting words first: the quotation ends the sentence, unless it goes on; Thai sentences end without a mark, so only its word for `that` tells
    body = f"[^{OPEN}{CLOSE}]*{ends}{SPACE}?[^{OPEN}{CLOSE}\\s{SPACE}]{CLOSE}"
    stays = rf"(?!\s*(?:{SMALL}|[,;:，、；：.。!?！？と]))"
    blank = r"[ \t\r\n\u00a0]{0,3}"
    rows = rows.withColumn(text, F.when(_needed(c, "“„«»「『‘\"'"), _mask_spans(c, QUOTES, "“„«»「『‘\"'")).otherwise(c))
    steps = [
        (OPEN, rf"({OPEN}(?<=[{LETTER}\p{{N}},，、:：>&&[^{THAI}]]{blank}{OPEN})(?!.[{THAI}]){body}){stays}", f"$1{CUT}"),
        (OPEN, rf"({OPEN}(?<=(?:ว่า|[:：]){blank}{OPEN}).[{THAI}]{body.replace(ends, '')})", f"$1{CUT}"),
    ]
    return _apply(rows, text, steps).withColumn(text, F.when(_needed(c, OPEN), _drop_signs(c)).otherwise(c))


_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々]\p{M}?"
_SPACED = r"[\p{IsArabic}\p{IsDevanagari}\p{M}]+(?:[ \n][\p{IsArabic}\p{IsDevanagari}\p{M}]+){0,2}"
#: Where an opening begins: nothing but white space, numbers and signs since the last boundary.
_OPENING = rf"((?:^|{CUT})[\s{BLANK}]*+(?:\p{{N}}++[ ](?:\p{{S}}[ ]?)?)?)"
_DOTS = r"(?:…|\.\.\.)"
_ENDS = [
    # full-width and Indic terminators end wherever they are; a run of marks and closers belongs together
    rf"[。！？।॥؟｡][。！？।॥؟｡!?.…]*+[{CLOSERS}]*+",
    # ASCII terminators end before white space, other scripts and capitals; a dot doesn't before a small letter
    rf"[!?]++[!?.]*+[{CLOSERS}]*+(?=[\s{BLANK}]|$|\p{{Lu}}|[^\x00-\x7f\p{{Ll}}{CUT}{MASKED}])",
    rf"\.(?<!\.\.)(?!\.)[{CLOSERS}]*+(?=[\s{BLANK}]|$|\p{{Lu}}[\p{{Ll}} ]|[“„«¿¡\p{{IsArabic}}\p{{IsDevanagari}}{THAI}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])(?!\s*+{SMALL})",
]
TERMINATORS: list[Step] = [
    ("", f"({'|'.join(_ENDS)})", f"$1{CUT}"),
    # the Greek question mark
    (";\u037e", rf"([;\u037e](?<=\p{{IsGreek}}\p{{M}}{{0,2}}[;\u037e])[{CLOSERS}]*)(?=[\s{BLANK}]|$)", f"$1{CUT}"),
    (";\u037e", rf"([;\u037e])(?=\s+\p{{IsGreek}}(?<=\p{{Lu}}))", f"$1{CUT}"),
    (BLANK, BLANK, BLANK + CUT),
]
#: An ellipsis behind a short opening (no more than a subject) of a script without capitals goes on, and so it does in Thai; any other ends.
ELLIPSES: list[Step] = [
    ("…", rf"(?m){_OPENING}((?:{_CJK}){{1,8}}|{_SPACED})…", f"$1$2{ELL}"),
    (".", rf"(?m){_OPENING}((?:{_CJK}){{1,8}}|{_SPACED})\.\.\.", f"$1$2{DOT * 3}"),
    ("…", r"…(?<=[฀-๿]…)", ELL),
    (".", r"\.\.\.(?<=[฀-๿]\.\.\.)", DOT * 3),
    ("", rf"({_DOTS}[….]*[{CLOSERS}]*)", f"$1{CUT}"),
    # the same behind a sentence that an ellipsis ended
    ("", rf"([….]{CUT}\s{{0,3}}(?:(?:{_CJK}){{1,8}}|{_SPACED}){_DOTS}){CUT}", "$1"),
]


def with_terminators(rows: DataFrame, text: str) -> DataFrame:
    """Step 3: a CUT behind every terminator with its closing marks."""
    rows = _apply(rows, text, TERMINATORS)
    c = F.col(text)
    has = c.contains("…") | c.contains("...")
    for needs, pattern, to in ELLIPSES:
        rows = rows.withColumn(text, F.when(has & _needed(c, needs) if needs else has, _sub(c, pattern, to)).otherwise(c))
    return rows


# Thai words that go on with a statement, and words after which it can't end.
THAI_GOES_ON = "และ แต่ เพราะ เช่น คือ ประมาณ ซึ่ง โดย เพื่อ(?!น) ดังนั้น ฯลฯ ข้อ วันที่ ครับ ค่ะ คะ(?!แ) นะ".split()
# Thai units and counting words behind a number.
THAI_UNITS = "บาท สตางค์ กิโล กรัม เมตร เซนติเมตร ลิตร ชั่วโมง นาที วินาที เปอร์เซ็นต์ ล้าน องศา นาฬิกา".split()
THAI_LEADS = "เช่น คือ ประมาณ ข้อ วันที่ ว่า".split()


def with_thai(rows: DataFrame, text: str) -> DataFrame:
    """Step 3 for Thai, which puts spaces between statements, but also inside them.

    A space ends a statement behind a closing particle or question word, behind the words that report a quotation which
    opens it, and between two long stretches; a first short stretch (an adverbial in front) goes with what follows, and a
    conjunction or a number with its unit with what precedes.
    """
    thai = THAI
    months = rf"(?:[พมกสตธ]|มี|เม|มิ){DOT}"
    keep = rf"(?:{'|'.join(THAI_GOES_ON)}|{months})"
    leads = rf"(?:{'|'.join(THAI_LEADS)})"
    starts = rf"(?!\S{{1,4}}[ ]+ข้อ[ ])(?:[{thai}“\"]|[A-Za-z]+(?:{DOT}[  ]?[A-Za-z]+)*[{thai}]|\p{{Ll}}++\p{{Lu}}\p{{L}}++[ ][{thai}]|[0-9]+[ ](?:\p{{Sm}}[ ])?(?!{keep})[{thai}])"
    unit = rf"(?:{'|'.join(THAI_UNITS)})"
    between = rf"(?=[ ]+(?!{keep}|(?<=\p{{N}}[ ]){unit}|[{thai}]++[ ]ฯลฯ){starts})"
    # runs of characters are single classes, so that matching needs no stack however long a text is
    run = rf"[^ {CUT}\n\r{BLANK}]"
    inner = rf"(?:(?<={leads})[ ]|(?<=\p{{N}})[ ](?={unit})|(?<={DOT}[คพย]{DOT})[ ](?=ที่)|(?<=[A-Z]{DOT})[ ]|[ ]++(?:(?={keep})|(?!{starts})))"
    name = rf"(?:\p{{Ll}}++\p{{Lu}}\p{{L}}++[ ]|[A-Za-z][A-Za-z{DOT} ]*+)?"
    more = rf"(?:{inner}{run}++)*+"
    led = rf"[{thai}]{{1,16}}[ ]+(?!{keep}){name}[{thai}](?:{run}{{9,}}+{more}|{run}*+{inner}{run}++{more})"
    alone = rf"{name}[{thai}](?:{run}{{16,}}+{more}|{run}*+{inner}{run}++{more})"
    # a quotation that opens a statement, and who says so; again when more openings are known
    told = ("”\"»』」", rf"(?m)((?:^|[{CUT}{BLANK}])\s*+[“\"«『「][^“”\"«»『』「」{CUT}{BLANK}]*+[”\"»』」][ ]{{0,2}}[{thai}]++){between}", f"$1{CUT}")
    steps = [
        ("", rf"((?<=[{thai} ])(?:ครับ|ค่ะ|คะ|ไหม|หรือเปล่า))(?=[ ]+)(?![ ]+(?:ครับ|ค่ะ|[!?.]))", f"$1{CUT}"),
        told,
        # the longest statement from here gets a tentative boundary, so that no text is walked through twice; it stays where a statement can end
        ("", rf"(?<![{thai}])({led}|{alone})", f"$1{OPEN}"),
        (OPEN, rf"(?<!{leads})(?<![”\"»』」]){OPEN}{between}", CUT),
        (OPEN, OPEN, ""),
        told,
    ]
    c = F.col(text)
    here = c.rlike(f"[{thai}]")
    rows = rows.withColumn("__thai", here)
    for needs, pattern, to in steps:
        rows = rows.withColumn(text, F.when(F.col("__thai") & _needed(c, needs) if needs else F.col("__thai"), _sub(c, pattern, to)).otherwise(c))
    return rows.drop("__thai")


def with_boundaries(rows: DataFrame, text: str) -> DataFrame:
    """Put CUT behind every sentence of a text column; without CUT it has the length of the original."""
    for step in (with_masks, with_spans, with_terminators, with_thai):
        rows = step(rows, text)
    return rows


#: Pieces that are summed up in one go; more are summed by blocks, so that the work stays in proportion.
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each element and of all: one more than there are lengths."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _starts(lengths: str) -> Column:
    """Where each piece starts: sums over blocks, and within each block."""
    n = F.col(lengths)
    numbers = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
    sums = _running(F.transform(numbers, lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x)))
    blocks = F.flatten(F.transform(F.arrays_zip(numbers.alias("b"), sums.alias("s")), lambda z: F.when(z["b"].isNull(), F.array().cast("array<int>")).otherwise(F.transform(F.slice(_running(F.slice(n, z["b"] * BLOCK + 1, F.lit(BLOCK))), 1, F.least(F.lit(BLOCK), F.size(n) - z["b"] * BLOCK)), lambda x: x + z["s"]))))
    return F.when(F.size(n) <= BLOCK, F.slice(_running(n), F.lit(1), F.size(n))).otherwise(blocks)


def split_sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, start_char, end_char (code points from 0, end exclusive) and sentence, one row per unit.

    Null, empty and blank texts give no row. Units have no outer white space; all other characters are in exactly one.
    The operator is a projection: no shuffle, no Python, whole texts of any length; other columns are dropped.
    """
    rows = df.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    # the original goes along only where it holds placeholders itself
    rows = rows.withColumn("__holds", F.col("__text").rlike(r"[\ue000-\ue0ff]"))
    own = F.when(F.col("__holds"), F.col("__text"))
    free = F.when(F.col("__holds"), F.translate("__text", PLACEHOLDERS, "x" * len(PLACEHOLDERS))).otherwise(F.col("__text"))
    rows = rows.select(*keys, own.alias("__own"), free.alias("__cut"))
    rows = with_boundaries(rows, "__cut").withColumn("__pieces", F.split("__cut", CUT, -1))
    rows = rows.withColumn("__lengths", F.transform("__pieces", F.length))
    pieces = F.arrays_zip(F.col("__pieces").alias("p"), _starts("__lengths").alias("at"))
    rows = rows.select(*keys, "__own", F.explode(pieces).alias("__u")).select(*keys, "__own", F.col("__u.p").alias("__p"), F.col("__u.at").alias("__at"))
    bare = F.ltrim(F.col("__p"), F.lit(WHITE))
    rows = rows.select(*keys, "__own", "__at", F.length("__p").alias("__n"), bare.alias("__p")).select(*keys, "__own", (F.col("__at") + F.col("__n") - F.length("__p")).cast("long").alias("start_char"), F.rtrim(F.col("__p"), F.lit(WHITE)).alias("__p"))
    end = F.col("start_char") + F.length("__p")
    # placeholders turned back; a text that held some itself is cut from the original
    own = F.substring(F.col("__own"), (F.col("start_char") + 1).cast("int"), F.length("__p"))
    sentence = F.when(F.col("__own").isNotNull(), own).otherwise(F.translate("__p", MASKED, MARKS))
    return rows.filter(F.length("__p") > 0).select(*keys, "start_char", end.alias("end_char"), sentence.alias("sentence"))
