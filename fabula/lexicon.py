"""Fixed values of the Ukrainian rule set: word lists, characters and patterns that results depend on."""

from __future__ import annotations

# --- characters -------------------------------------------------------------------------
LOOKALIKE_LATIN = "aceopxyiACEOPXYI"
LOOKALIKE_CYRILLIC = "асеорхуіАСЕОРХУІ"
DASHES = "\\-\u2012\u2013\u2014\u2015"
QUOTES = "«\"„“”'’"
CLOSING = "»\"”'’"
END_PUNCTUATION = "[.!?…\"”»]"
NAME = r"[A-ZА-ЯЇІЄҐ][\w’'\-]+"

#: A body that is speech: it starts with a dash or a quotation mark.
DIALOG = rf"^[\s\u00A0]*[{DASHES}{QUOTES}]"
#: A tagged line: indent, speaker, body.
TAG = r"(?d)^(\s*)#g(\d+|\?)\s*:\s*(.*)$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# --- verbs of speech, by rule ------------------------------------------------------------
SAY_VERBS = "сказав|сказала|кажу|каже|відповів|відповіла|спитав|спитала|крикнув|крикнула|вигукнув|вигукнула|прошепотів|прошепотіла|буркнув|буркнула|мовив|промовила|пояснив|пояснила|гукнув|гукнула"
SAY_MASCULINE = ("сказав", "кажу", "каже", "відповів", "спитав", "крикнув", "вигукнув", "прошепотів", "буркнув", "мовив", "пояснив", "гукнув")
SAY_FEMININE = ("сказала", "відповіла", "спитала", "крикнула", "вигукнула", "прошепотіла", "буркнула", "промовила", "пояснила", "гукнула")
VERBS_M = "сказав|відповів|спитав|запитав|крикнув|вигукнув|прошепотів|буркнув|мовив|промовив|пояснив|гукнув|відказав"
VERBS_F = "сказала|відповіла|спитала|запитала|крикнула|вигукнула|прошепотіла|буркнула|промовила|пояснила|гукнула|відказала"
VERBS_N = "каже|говорить|питає|запитує|кричить|вигукує|шепоче|бурчить|мовить|промовляє|пояснює|гукає|відказує|додає|зазначає|просить|велить|нагадує"
VERBS_ANY = f"{VERBS_M}|{VERBS_F}|закричала|{VERBS_N}"
FIRST_PERSON_VERBS = "повторюю|кажу|говорю|відповідаю|питаю|запитую|показую|обзиваю|киваю|наголошую|зазначаю|прошу|гукаю|відказую"
FIRST_PERSON_WORDS = "я|мені|мене|мною|мій|моє|мої|кажу|говорю|відповідаю|питаю|прошу|дякую|зізнаюся|шепочу|бурмочу|вигукую|кричу|показую|звертаюся|стримуюсь|охаю|хочу|сплю"
FIRST_PERSON_NOW = "кажу|відповідаю|питаю|запитую|кричу|шепочу|бурчу|мовлю|промовляю|пояснюю|додаю|зазначаю|прошу|гукаю|відказую"
FIRST_PERSON_PAST = "сказав|відповів|запитав|крикнув|вигукнув|прошепотів|буркнув|мовив|промовив|пояснив|гукнув|відказав|сказала|відповіла|запитала|крикнула|вигукнула|прошепотіла|буркнула|промовила|пояснила|гукнула|відказала"
FIRST_PERSON_LEADIN = rf"(?:я\s+(?:{FIRST_PERSON_NOW})|(?:{FIRST_PERSON_NOW}|{FIRST_PERSON_PAST})\s+я)"
FIRST_PERSON_TAIL = rf"(?:{FIRST_PERSON_PAST})\s+я|я\s+(?:{FIRST_PERSON_NOW})"
NARRATOR_FIRST_PERSON = "я|мені|мене|мною|мій|моє|мої"
CHILD_WORDS = "я|мені|мене|мною|мій|моє|мої|кажу|говорю|відповідаю|питаю|прошу|дякую|зізнаюся|шепочу|бурмочу|вигукую|кричу|показую|звертаюся|стримуюсь|охаю"
# --- the pair of speakers, lead-ins that end with a colon
PAIR_VERBS = "сказав|сказала|сказали|відповів|відповіла|відповіли|крикнув|крикнула|крикнули|мовив|промовила|звернувся|звернулась|шепотів|шепотіла"
COLON_VERBS = "сказав|повідомив|запитав|спитав|поцікавився|крикнув|вигукнув|прошепотів|промовив|відповів|буркнув|процедив|торохтів|заторохтів|сказала|повідомила|запитала|спитала|поцікавилася|крикнула|вигукнула|прошепотіла|промовила|відповіла|буркнула|процедила|торохтіла|заторохтіла|каже|говорить|повідомляє|питає|запитує|відповідає|вигукує|кричить|шепоче|промовляє|бурчить|торохтить"
CONSENSUS_M = "він|йому|ним|ньому|нього|цей|цього|цьому|цим|той|того|тому|тим"
CONSENSUS_F = "вона|її|їй|неї|нею|ця|цієї|цій|цією|цю|та"

# --- thoughts, sayings, titles -------------------------------------------------------------
THOUGHT_VERBS = "подумки|подумав|подумала|міркував|міркувала|розмірковував|розмірковувала"
THOUGHT_PHRASES = "про себе|в думках|майнула думка"
NEAR_THOUGHT = rf"афоризм\w*|прислів'я|приказк\w*|думк\w*|{THOUGHT_VERBS}"
NEAR_APHORISM = rf"{NEAR_THOUGHT}|цитат\w*"
TITLES = r"вожд\w*|ватаж\w*|лідер\w*"
TITLE_STEMS = "ватаж|вожд|лідер"
PRONOUNS_M = "він|йому|ним|ньому|нього|цей|цього|цьому|цим|той|того|тому|тим"
PRONOUNS_F = "вона|її|їй|неї|нею|цій|цією|цієї|цю|ця"
CROWD = r"\b(інші|усі|всі|вони|люди|решта|натовп)\b.*\b(кричать|гукають|вигукують|волають|свистять|співають|регочуть|галасують)\b"

# --- the legend --------------------------------------------------------------------------
NARRATOR_KEYWORDS = "оповідач|наратор|диктор|voiceover|narrator"
SERVICE_TOKENS = ("m", "f", "оповідач", "наратив", "сучасні сцени", "сучасний співрозмовник", "головний герой")
ALIAS_STOPS = ("f", "m", "жінка", "чоловік", "дитина", "оповідач", "наратив", "сучасні сцени", "сучасний співрозмовник", "головний герой")
FEMALE_STEMS = "жін|дів|мати|мам|баб|правнуч|донь"
MALE_STEMS = "чолов|хлоп|дід|дідо|дідус|старійшин|ватаж"

#: Endings by which case forms of a name differ.
CASE_ENDINGS = ("ою", "ею", "єм", "ем", "ом", "єю", "ами", "ові", "еві", "ї", "ю", "у", "а", "і", "е")

#: Vocative forms of kin words, by base form.
KIN_FORMS = {
    "дід": ("дід", "діду", "дідом", "діде", "діда", "дідоню", "дідусю", "дідусь", "дідуся", "дідусем"),
    "баба": ("баба", "бабо", "бабу", "бабусю", "бабусе", "бабуню", "бабцю", "бабце"),
    "тато": ("тато", "тату", "тата", "татусю", "татусе", "татусем"),
    "мама": ("мама", "мамо", "маму", "матусю", "матусе", "мамусю", "мамусе"),
    "сину": ("сину", "сине", "сина", "сином", "синочку", "синочек"),
    "доня": ("доню", "доня", "донюню", "донечко", "донечці", "донечкою"),
}

# --- the speaker model -------------------------------------------------------------------
HINT_M = "сказав|відповів|промовив|крикнув|вигукнув|прошепотів|буркнув|звернувся|процедив|відказав|зазначив|погодився"
HINT_F = "сказала|відповіла|промовила|крикнула|вигукнула|прошепотіла|буркнула|звернулась|процедила|відказала|зазначила|погодилась"
EXPLICIT_VERBS = "сказав|сказала|відповів|відповіла|запитав|запитала|спитав|спитала|промовив|промовила|вигукнув|вигукнула|прошепотів|прошепотіла"

# --- scenes ------------------------------------------------------------------------------
SCENE_HEADING = r"(?iuU)^\s*(?:#g1\s*:\s*)?(?:(пролог|епілог)|(глава|розділ|частина)\s+(\d+|[IVXLCDM]+))\.?\s*$"
END_OF_PROLOGUE = r"(?iuU)^\s*(?:#g1\s*:\s*)?кінець\s+прологу\.?\s*$"
SEPARATOR = r"(?iuU)^\s*(?:[\-=*_#~·•.\u2012\u2013\u2014\u2015 ]{3,}|[\-\u2013\u2014 ]*\b(?:page|сторінка)\b[ \t]*\d+[ \t]*[\-\u2013\u2014 ]*)\s*$"

# --- gold marks, in order of preference --------------------------------------------------
GOLD_MARKS = (r"(?i)⟦\s*(#g\d+)\s*⟧", r"(?i)\{gold\s*:\s*(#g\d+)\}", r"(?i)//\s*gold\s*:\s*(#g\d+)", r"(?i)#\s*gold\s*(#g\d+)")

# --- emotions ----------------------------------------------------------------------------
EMOTION_KEYWORDS = {
    "Anger": ("кипіло", "дратував", "кулак", "злість", "палала", "вдарив", "напружене", "викликом", "роздратування"),
    "Disgust": ("відрази", "відвернутися", "холод у животі", "огидно", "забрудненим", "нудило", "видовища"),
    "Surprise": ("не вірячи", "очам", "зупинився", "перехопило", "незвичним", "неймовірним", "не вкладається", "здивувався"),
    "Fear": ("кровотечу", "скло", "уламки", "застрягли", "глибоко", "порізу", "рани", "небезпечно", "венами", "протяг", "холодний"),
    "Sadness": ("боліла", "боліло", "бажання смерті", "найгірше відчуття", "не міг згадати", "лежав", "не мертвий", "важко", "біль", "порожні очі"),
}
EMOTION_TAGS = {"Fear": "#heart", "Anger": "#v"}

# --- letters of another language in a corrected text ----------------------------------------
FOREIGN_LETTERS = "ыэё"
