"""Answers of models: options, yes or no, text clean-up, and scores against references. All are expressions of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that refuse, and the failure message of a call.
REFUSALS = ("Sorry, I can't help with images of people yet.", "I can't process this file.", "I'm sorry, but without the image provided", "Cannot determine the answer")
FAILED = "Failed to obtain answer via API"
#: Characters that part options, and answer prefixes (two pairs are one string each, so hardly ever occur).
OPTION_MARKS = ".()[],:;!*#{}"
ANSWER_PREFIXES = ("The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:")
#: Punctuation that is taken off or blanked.
PUNCTUATION = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
ARTICLES = ("a", "an", "the")
#: Words that stand for digits.
DIGITS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
#: Words written without their apostrophe, and with it.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's",
    "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't",
    "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't",
    "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't",
    "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at",
    "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've",
    "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's",
    "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll",
    "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've",
    "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def any_of(text: Column, parts: Iterable[str]) -> Column:
    """Whether the text holds one of the strings."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(F.lit(p))
    return out


def tokens(text: Column) -> Column:
    """The text's parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def without(text: Column, parts: Iterable[str], by: str = "") -> Column:
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(by))
    return text


def option(answer: Column, letters: Column) -> Column:
    """The one of letters (an array) that the answer names; Z for a refusal, or a lone Z; null if none or several are named."""
    words = tokens(without(answer, OPTION_MARKS, " "))
    named = F.filter(letters, lambda c: F.array_contains(words, c))
    found = F.when(F.size(named) == 1, F.element_at(named, 1)).when((F.size(named) == 0) & F.array_contains(words, "Z"), "Z")
    return F.when(answer.contains(FAILED), None).when(any_of(answer, REFUSALS), "Z").otherwise(found)


def option_by_text(answer: Column, options: Column) -> Column:
    """The letter of the one option (map letter -> text) whose text is in the answer, case aside; null if none or several."""
    hit = F.filter(F.map_entries(options), lambda e: F.contains(F.lower(answer), F.lower(e["value"])))
    return F.when(F.size(hit) == 1, F.element_at(hit, 1)["key"])


def inferred(answer: Column, options: Column) -> Column:
    """The option named by letter, or else by text."""
    return F.coalesce(option(answer, F.map_keys(options)), option_by_text(answer, options))


def first_letter(answer: Column, letters: str = "ABCDE") -> Column:
    """The first option letter after common prefixes; of answers without one, the letter of the choice that holds the text;
    empty for over ten words without a letter."""
    s = F.trim(without(F.trim(answer), ANSWER_PREFIXES))
    found = F.regexp_extract(s, f"[{letters}]", 0)
    choice = F.lit("")
    for c in reversed(letters):
        choice = F.when(F.contains(F.lit(f"({c})".lower()), F.lower(s)), c).otherwise(choice)
    return F.when((F.size(tokens(s)) > 10) & (found == ""), "").when(found != "", found).otherwise(choice)


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once, not at every place that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def punctuation(text: Column) -> Column:
    """Marks beside a space, and all marks of a text with a comma between digits, go; other marks become spaces. Of the
    periods that no digit follows the first 32 go."""

    def marks(t: Column, comma: Column) -> Column:
        out = t
        for p in PUNCTUATION:
            beside = comma | t.contains(F.lit(p + " ")) | t.contains(F.lit(" " + p))
            out = F.replace(out, F.lit(p), F.when(beside, F.lit("")).otherwise(F.lit(" ")))
        return out

    def joined(part: Column) -> Column:
        return F.when(F.size(part) <= 33, F.array_join(part, "")).otherwise(F.concat(F.array_join(F.slice(part, 1, 33), ""), F.lit("."), F.array_join(F.slice(part, 34, F.size(part)), ".")))

    plain = _let(text, lambda t: _let(t.rlike(r"\d,\d"), lambda comma: marks(t, comma)))
    return _let(F.split(plain, r"\.(?!\d)"), joined)


def digits_and_articles(text: Column) -> Column:
    """Lower-case words, number words as digits, without articles, contractions with their apostrophes."""
    digit, apostrophe = literal_map(DIGITS), literal_map(CONTRACTIONS)
    words = F.transform(tokens(F.lower(text)), lambda w: F.coalesce(F.try_element_at(digit, w), w))
    return F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(*ARTICLES)), lambda w: F.coalesce(F.try_element_at(apostrophe, w), w)), " ")


def answer_text(text: Column) -> Column:
    """An answer as it is compared: line ends and tabs as spaces, punctuation, digits, articles."""
    return digits_and_articles(punctuation(F.trim(F.translate(text, "\n\t", "  "))))


def answer_texts(texts: Column) -> Column:
    """answer_text of each of the texts; equal ones are processed once."""
    known = lambda u: F.map_from_arrays(u, F.transform(u, answer_text))
    return _let(texts, lambda a: _let(known(F.array_distinct(F.array_compact(a))), lambda m: F.transform(a, lambda x: F.try_element_at(m, x))))


def yes_or_no(text: Column) -> Column:
    """Yes or No, if one of the words is there and the other isn't, else Unknown."""
    words = tokens(punctuation(F.lower(text)))
    yes, no = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def agreement(prediction: Column, answers: Column) -> Column:
    """Mean over the answers (processed texts) of min(1, equal ones among the others / 3). Answers that equal the prediction
    have one less among the others than those that don't, so their number tells the mean."""
    some = lambda k: F.least(F.lit(1.0), k / 3.0)
    mean = lambda k, n: (k * some(k - 1) + (n - k) * some(k)) / n
    given = F.struct(prediction.alias("prediction"), answers.alias("answers"))
    same = lambda s: F.size(F.filter(s["answers"], lambda x: x == s["prediction"]))
    return _let(given, lambda s: F.when(s["answers"].isNotNull(), _let(same(s), lambda k: mean(k, F.size(s["answers"])))))


def exact(prediction: Column, answers: Column) -> Column:
    """1.0 if an answer equals the prediction, case and outer spaces aside."""
    return F.when(F.exists(answers, lambda x: F.lower(F.trim(x)) == F.lower(F.trim(prediction))), 1.0).otherwise(0.0)


_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """The text as a double, a percentage divided by 100; null if it is none."""
    bare = F.regexp_replace(text, "%+$", "")
    value = F.when(bare.rlike(_NUMBER), F.trim(bare).try_cast("double"))
    return F.when(F.endswith(text, F.lit("%")), value / 100.0).otherwise(value)


def relaxed(target: Column, prediction: Column, most: float = 0.05) -> Column:
    """Numbers within `most` of the target, taken as decimals so that the boundary itself is within; texts (and a target
    that is zero or no number) equal, case aside."""
    t, p = number(target), number(prediction)
    dec = lambda x: x.try_cast("decimal(30,10)")
    near = F.coalesce(F.abs(dec(p) - dec(t)) <= F.abs(dec(t)) * F.lit(str(most)).cast("decimal(10,6)"), F.abs(p - t) <= F.abs(t) * most)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), near).otherwise(F.lower(prediction) == F.lower(target))


def edit_share(truth: Column, prediction: Column, collapsed: bool = True) -> Column:
    """Edit distance over the longer text's length (as given); collapsed: case and runs of white space aside."""
    flat = lambda x: F.lower(F.array_join(tokens(x), " ")) if collapsed else x
    longest = F.greatest(F.length(truth), F.length(prediction))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(flat(truth), flat(prediction)) / longest)


def anls_collapsed(truths: Column, prediction: Column, threshold: float = 0.5) -> Column:
    """1 - the least distance share to the truths; 0 below the threshold."""
    best = 1 - F.array_min(F.transform(truths, lambda t: edit_share(t, prediction)))
    return F.when(best < threshold, 0.0).otherwise(best)


def anls(truth: Column, prediction: Column, threshold: float = 0.5) -> Column:
    """The same of raw strings; 0 up to the threshold."""
    value = 1.0 - edit_share(truth, prediction, collapsed=False)
    return F.when(value <= threshold, 0.0).otherwise(value)


def bag_f1(prediction: Column, truth: Column) -> Column:
    """F1 of words by membership, not by count."""
    p, g = tokens(F.lower(prediction)), tokens(F.lower(truth))
    hit = F.size(F.filter(p, lambda x: F.array_contains(g, x)))
    precision, recall = hit / F.size(p), hit / F.size(g)
    return F.when((hit == 0) | (F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def clean(text: Column) -> Column:
    """Lower case, without parentheses, outer quotes, leading $ and trailing %."""
    s = F.trim(F.regexp_replace(F.trim(F.lower(text)), r"\s*\([^)]*\)", ""))
    s = F.trim(F.regexp_replace(s, r"^['\"]|['\"]$", ""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"^\$+", "")), r"%+$", ""))


#: Texts that must match exactly (sites, code files, pages, telephone numbers, times, dates, addresses).
EXACT = r"https://|\.py$|ipynb$|^page|^\d+(-\d+|\s\d+)?$|a\.m\.|p\.m\.|^\d{4}[-\s]\d{2}[-\s]\d{2}$|^\d{4}[-\s]\d{2}$|^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def must_match(text: Column) -> Column:
    return text.rlike(EXACT)


def _places(text: Column) -> Column:
    return F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(3)


def float_equal(reference: Column, prediction: Column, percentages: bool = True, close: bool = True) -> Column:
    """Whether the prediction is the reference, or a hundredth or hundredfold of it: within 1 % (close), or equal when
    rounded to the fewer decimals of both, two at least."""
    r, p = reference.cast("double"), prediction.cast("double")
    out = F.lit(False)
    for item in (r / 100, r, r * 100) if percentages else (r,):
        if close:
            out = out | (F.abs(item - p) <= 0.01 * F.greatest(F.abs(item), F.abs(p)))
        places = F.greatest(F.least(_places(p.cast("string")), _places(item.cast("string"))), F.lit(2))
        scale = F.pow(F.lit(10.0), places)
        out = out | (F.rint(p * scale) == F.rint(item * scale))
    return F.coalesce(out, F.lit(False))


def typed_score(truth: Column, prediction: Column, kind: Column) -> Column:
    """Score of texts by the answer's type: Int by whole numbers, Float by float_equal, Str by exact match or anls, anything
    else as a list, in JSON: sorted members pairwise, 0 for another length."""
    whole = lambda x: F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double"))
    as_int = (F.when(truth.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(truth).try_cast("double")) == F.floor(F.abs(whole(prediction))) * F.signum(whole(prediction))).cast("double")
    as_float = float_equal(whole(clean(truth)), whole(clean(prediction))).cast("double")
    g, p = clean(truth), clean(prediction)
    as_text = F.when(must_match(g), (g == p).cast("double")).otherwise(anls(g, p))
    listed = lambda x: F.sort_array(F.transform(F.when(F.startswith(x, F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.array(x)), clean))
    gs, ps = listed(truth), listed(prediction)
    strict = must_match(F.element_at(gs, 1)) | F.element_at(gs, 1).rlike(_NUMBER)
    as_list = F.when(F.size(gs) != F.size(ps), 0.0).when(strict, (F.array_join(gs, "-") == F.array_join(ps, "-")).cast("double")).otherwise(F.array_min(F.zip_with(gs, ps, lambda x, y: anls(x, y))))
    return F.when(kind == "Int", F.coalesce(as_int, F.lit(0.0))).when(kind == "Float", F.coalesce(as_float, F.lit(0.0))).when(kind == "Str", as_text).otherwise(as_list)


def first_words_agree(prediction: Column, truth: Column, advanced: bool = False) -> Column:
    """Whether the first words (options) hold one another; advanced: or the prediction holds the truth's content, a single
    digit as its word."""
    head = lambda x: F.substring_index(F.lower(x), " ", 1)
    out = F.contains(head(truth), F.replace(head(prediction), F.lit("."), F.lit(""))) | F.contains(head(prediction), head(truth))
    if not advanced:
        return out
    strip = lambda x: F.regexp_replace(x, r"^[. \n]+|[. \n]+$", "")
    content = strip(F.when(F.lower(truth).contains(" "), F.substring(F.lower(truth), F.length(head(truth)) + 2, F.length(truth))).otherwise(""))
    word = literal_map({str(i): w for i, w in enumerate("zero one two three four five six seven eight nine".split())})
    return out | F.contains(strip(F.lower(prediction)), F.coalesce(F.try_element_at(word, content), content))


def verdict(prediction: Column, truth: Column) -> Column:
    """1 if the prediction says true and the truth is 1, or false and 0; 0 otherwise; null if it says both."""
    p = F.lower(F.coalesce(prediction, F.lit("none")))
    yes, no = p.contains("true"), p.contains("false")
    return F.when(yes & no, None).when((yes & (truth == "1")) | (no & (truth == "0")), 1).otherwise(0)


#: Units that are taken off amounts, and what amounts are multiplied by.
UNITS = ("dollar", "gallons", "square feet", "shares", "mbtu", "mbpd", "mbbls", "mmbtu", "unit", "gwh", "year", "mmcf", "mile", "mboe")
SCALES = ((r" \bthousand\b", "e3"), (r" \bmillion\b", "e6"), (r" \bbillion\b", "e9"), (r"\bthousand\b", "e3"), (r"\bmillion\b", "e6"), (r"\bbillion\b", "e9"), (r" ?%", "e-2"))


def amount(text: Column) -> Column:
    """(value, bare): normalised amounts as text, with thousands, millions and percent as exponents, and without them."""
    s = F.regexp_replace(normalized(text), r"[\$\(\),]", "")
    s = F.regexp_replace(s, r"(?i)\b(" + "|".join(UNITS) + r")s?\b", "")
    bare = s
    for pattern, by in SCALES:
        s, bare = F.regexp_replace(s, pattern, by), F.regexp_replace(bare, pattern, "")
    plain = lambda x: F.coalesce(F.when(x.rlike(_NUMBER), F.trim(x).try_cast("double").cast("string")), x)
    return F.struct(plain(s).alias("value"), plain(bare).alias("bare"))


def amounts_agree(prediction: Column, truth: Column) -> Column:
    """Whether one of the prediction's readings is one of the truth's."""
    p, g = amount(prediction), amount(truth)
    return (p["value"] == g["value"]) | (p["value"] == g["bare"]) | (p["bare"] == g["value"]) | (p["bare"] == g["bare"])


#: Latin letters with marks and their base letters, made by decomposition (a rule, not a list).
def _marked() -> tuple[str, str]:
    import unicodedata

    pairs = {}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(cp):
            pairs[chr(cp)] = base
    return "".join(pairs), "".join(pairs.values())


def unmarked(text: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(text, *_marked()), r"\p{Mn}", "")


def normalized(text: Column) -> Column:
    """Without marks, with plain quotes and dashes, without citations and parentheses at the end and outer quotation marks
    (taken off in turn until nothing comes off), without a final period, in lower case with single spaces. What comes off
    makes the text shorter, so there are no more turns than characters; when a turn changes nothing the rest is passed over."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(unmarked(text), "[‘’´`]", "'"), "[“”]", '"'), "[‐‑‒–—−]", "-")

    def turn(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$", "")
        x = F.regexp_replace(F.trim(x), r"(?<!^)( \([^)]*\))*$", "")
        return F.regexp_replace(F.trim(x), r'^"([^"]*)"$', "$1")

    def step(state: Column, _: Column) -> Column:
        now = F.element_at(F.transform(F.array(turn(state["x"])), lambda y: F.struct(y.alias("x"), (y == state["x"]).alias("done"))), 1)
        return F.when(state["done"], state).otherwise(now)

    start = F.struct(x.alias("x"), F.lit(False).alias("done"))
    x = F.when(x.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.length(x)), start, step, lambda s: s["x"]))
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(x, r"\.$", ""), r"\s+", " ")))


def value_kind(text: Column) -> Column:
    """number, date (yyyy-mm-dd, xx for an unknown part) or string."""
    return F.when(text.rlike(_NUMBER), "number").when(text.rlike(r"^(\d{4}|xxxx)-(\d{2}|xx)-(\d{2}|xx)$"), "date").otherwise("string")


def values_equal(a: Column, b: Column) -> Column:
    """Numbers within 1e-6, other values (dates too, whose unknown parts fit only each other) when normalised alike."""
    x, y = F.trim(a).try_cast("double"), F.trim(b).try_cast("double")
    both = lambda k: (value_kind(a) == k) & (value_kind(b) == k)
    return F.when(both("number"), F.abs(x - y) < 1e-6).otherwise(normalized(a) == normalized(b))


def denotes(predicted: Column, targets: Column) -> Column:
    """Whether two lists are of one size and each target has an equal among the predicted."""
    return (F.size(predicted) == F.size(targets)) & F.forall(targets, lambda t: F.exists(predicted, lambda p: values_equal(t, p)))


def unescaped(cell: Column) -> Column:
    """A list of values out of an escaped cell: parts between |, with line ends, bars and backslashes restored."""
    restore = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))
    return F.transform(F.split(cell, r"\|"), restore)


_LATEX = ((r"\\left|\\right|\\,|\\!|\;|\$", ""), (r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)"), (r"\\cdot|\\times", "*"), (r"\\%", "%"), (r"\\text\{[^{}]*\}", ""), (r"[{}\s]", ""))


def math_value(text: Column) -> Column:
    """The value of a number, fraction, or fraction in LaTeX, as a double; null for what is none of these."""
    s = text
    for pattern, by in _LATEX:
        s = F.regexp_replace(s, pattern, by)
    part = r"\(?([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\)?"
    top, bottom = (F.regexp_extract(s, f"^([+-]?){part}/{part}$", i) for i in (2, 3))
    sign = F.when(F.regexp_extract(s, f"^([+-]?){part}/{part}$", 1) == "-", -1.0).otherwise(1.0)
    plain = F.when(s.rlike(f"^{part}$"), F.regexp_extract(s, f"^{part}$", 1).try_cast("double"))
    return F.when(s.rlike(f"^[+-]?{part}/{part}$"), sign * F.try_divide(top.try_cast("double"), bottom.try_cast("double"))).otherwise(plain)


def math_equal(a: Column, b: Column) -> Column:
    """Equal texts, case and outer spaces aside, or values within 1e-6."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | F.coalesce(F.abs(math_value(x) - math_value(y)) < 1e-6, F.lit(False))


def rough_answer(text: Column) -> Column:
    """Whether an answer is none of the refusals."""
    return ~(text.contains("I can't") | text.contains("I cannot") | F.lower(text).contains("sorry") | text.contains("无法") | text.contains("抱歉"))


def judge_scores(text: Column) -> Column:
    """Both numbers of a first line of two numbers, else -1 twice."""
    part = F.split(F.replace(F.trim(F.substring_index(text, "\n", 1)), F.lit(","), F.lit(" ")), r"\s+")
    a, b = (F.try_element_at(part, F.lit(i)).try_cast("double") for i in (1, 2))
    ok = (F.size(part) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(ok, F.array(a, b)).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def contained(answers: Column, prediction: Column, handwritten: Column) -> Column:
    """Whether an answer is in the prediction: for handwritten formulae without any white space and as written, otherwise in
    lower case with line ends as spaces."""
    flat = lambda x: F.regexp_replace(x, r"[\n ]", "")
    soft = lambda x: F.replace(F.trim(F.lower(x)), F.lit("\n"), F.lit(" "))
    return F.when(handwritten, F.exists(answers, lambda a: F.contains(flat(F.trim(prediction)), flat(F.trim(a))))).otherwise(F.exists(answers, lambda a: F.contains(soft(prediction), soft(a))))


def labelled_by_letters(question: Column, choices: Column) -> Column:
    """Whether a question is about letters: three of its choices are marks of one or two characters, Both, None of above, or
    made up of such; or a single letter is a word of the question."""
    words = lambda x: tokens(F.regexp_replace(x, r"[^\w\s]", " "))
    short = lambda x: x.isin("{}", "Both", "None of above") | (F.length(x) <= 2) | ((F.size(words(x)) > 1) & F.forall(words(F.regexp_replace(F.regexp_replace(x, "^Stage ", ""), " and ", " ")), lambda w: F.length(w) <= 2))
    return (F.size(F.filter(choices, short)) >= 3) | F.exists(words(question), lambda w: w.rlike("^[a-zA-Z]$"))

