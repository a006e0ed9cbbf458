"""Texts with tags: thoughts and answers, mask tokens, phrases, objects, boxes, scene graphs, images; and their rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = r"<\|mt_start\|><\|mt_\d{4}\|><\|mt_\d{4}\|><\|mt_end\|>"
_PHRASE = r"<\|object_ref_start\|>(.*?)\s*<\|object_ref_end\|>\s*(<\|mt_start\|>(?:<\|mt_\d+\|>){2}<\|mt_end\|>)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match, null without a match (an empty group is a match)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def thought(text: Column) -> Column:
    """What <think> holds; without it, what precedes <answer>, or else </think>."""
    before = F.when(text.contains("<answer>"), F.substring_index(text, "<answer>", 1)).when(text.contains("</think>"), F.substring_index(text, "</think>", 1))
    return F.coalesce(_found(text, r"(?s)<think>(.*?)</think>"), before)


def answer(text: Column) -> Column:
    """What <answer> holds; without its end, what follows <answer>, or else </think>."""
    after = lambda tag: F.substring(text, F.locate(tag, text) + len(tag), F.length(text))
    return F.coalesce(_found(text, r"(?s)<answer>(.*?)</answer>"), F.when(text.contains("<answer>"), after("<answer>")).when(text.contains("</think>"), after("</think>")))


def well_formed(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"), 1.0).otherwise(0.0)


def segments(text: Column, mark: str = "[SEG]") -> Column:
    """(reasoning, answer): places of the mark, counted from 0, outside and inside the first answer span."""
    whole = F.regexp_extract(text, r"(?s)<answer>.*?</answer>", 0)
    at = F.when(whole == "", F.length(text) + 1).otherwise(F.expr("1") * F.position(whole, text))
    count = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    before, inside = count(F.substring(text, F.lit(1), at - 1)), count(whole)
    total = count(text)
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.concat(span(F.lit(0), before), span(before + inside, total)).alias("reasoning"), span(before, before + inside).alias("answer"))


def mask_numbers(text: Column, paired: bool = False) -> Column:
    """Numbers of the mask tokens in order; paired: of whole masks of two tokens only."""
    source = F.array_join(_all(text, MASK), "") if paired else text
    return F.transform(_all(source, r"<\|mt_(\d{4})\|>", 1), lambda x: x.cast("int"))


def repaired_masks(text: Column) -> Column:
    """Masks of two tokens each: further tokens go, a missing second one is 9999, as is a missing end."""
    text = F.regexp_replace(text, r"(<\|mt_start\|>)(<\|mt_\d+\|>)(<\|mt_\d+\|>)(?:<\|mt_\d+\|>)+<\|mt_end\|>", "$1$2$3<|mt_end|>")
    text = F.regexp_replace(text, r"(<\|mt_start\|>)(<\|mt_\d+\|>)(<\|mt_end\|>)", "$1$2<|mt_9999|><|mt_end|>")
    return F.regexp_replace(text, r"(<\|mt_start\|>)(<\|mt_\d+\|>)(?!<\|mt_)", "$1$2<|mt_9999|><|mt_end|>")


def mask_grade(one: Column, other: Column) -> Column:
    """1 for equal masks, 0.8 if all tokens but the last agree, 0.4 if all but the last two do, else 0."""
    a, b = (_all(x, r"<\|[^|]*\|>") for x in (one, other))
    head = lambda x, n: F.array_join(F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0))), "")
    return F.when(one == other, 1.0).when(head(a, 1) == head(b, 1), 0.8).when(head(a, 2) == head(b, 2), 0.4).otherwise(0.0)


def _best(found: Column, wanted: Column, grade) -> Column:
    """Sum over the distinct found of their best grade among the wanted, over the longer list's length."""
    each = F.transform(F.array_distinct(found), lambda x: F.aggregate(F.array_distinct(wanted), F.lit(0.0), lambda a, y: F.greatest(a, grade(x, y))))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(found), F.size(wanted))


def mask_accuracy(text: Column, truth: Column) -> Column:
    """Grades of the text's masks against the truth's; 1 if neither has any, 0 for a null text."""
    p, g = _all(text, MASK), _all(truth, MASK)
    return F.when(text.isNull(), 0.0).when((F.size(p) == 0) & (F.size(g) == 0), 1.0).otherwise(_best(p, g, mask_grade))


def phrases(text: Column) -> Column:
    """Phrases of grounded captions, in lower case with single spaces; blank ones are left out."""
    words = F.transform(_all(text, _PHRASE, 1), lambda x: F.array_join(F.filter(F.transform(F.split(F.lower(x), " "), F.trim), lambda w: w != ""), " "))
    return F.filter(words, lambda x: x != "")


def phrase_masks(text: Column) -> Column:
    return F.transform(_all(text, _PHRASE, 2), lambda x: F.concat(F.lit("<|object_ref_end|>"), x))


def phrase_accuracy(text: Column, truth: Column) -> Column:
    p, g = phrases(text), phrases(truth)
    hit = F.size(F.filter(F.array_distinct(p), lambda x: F.array_contains(g, x)))
    return F.when(text.isNull(), 0.0).when(F.size(g) == 0, 1.0).otherwise(hit / F.greatest(F.size(p), F.size(g)))


def phrase_mask_accuracy(text: Column, truth: Column) -> Column:
    """As mask_accuracy, of masks that belong to phrases; null where neither side has any (0 / 0)."""
    p, g = phrase_masks(text), phrase_masks(truth)
    return F.when(text.isNull(), 0.0).when(F.greatest(F.size(p), F.size(g)) > 0, _best(p, g, mask_grade))


#: Fixed value: the format of one relation of a scene graph.
TRIPLET = r'\{\s*"subject"\s*:\s*\{\s*"mask_2d"\s*:\s*"[^"]*"\s*,\s*"label"\s*:\s*"[^"]*"\s*\}\s*,\s*"predicate"\s*:\s*"[^"]*"\s*,\s*"object"\s*:\s*\{\s*"mask_2d"\s*:\s*"[^"]*"\s*,\s*"label"\s*:\s*"[^"]*"\s*\}\s*\}'
_THING = "struct<mask_2d:string,label:string>"


def triplets(text: Column) -> Column:
    """Relations written in a text: array of (raw, subject, predicate, object)."""
    parsed = lambda x: F.from_json(x, f"subject {_THING}, predicate string, object {_THING}")
    return F.transform(_all(text, TRIPLET), lambda x: F.struct(x.alias("raw"), parsed(x).alias("t")))


def triplet_accuracy(text: Column, truth: Column) -> Column:
    """Relations found over the longer list: 1 for one written alike, else 0.5 for the same labels and predicate and a
    quarter of each mask's grade, the best of the truth's; each written form counts once."""
    p, g = triplets(text), triplets(truth)
    name = lambda x: F.concat_ws("#", x["t"]["subject"]["label"], x["t"]["predicate"], x["t"]["object"]["label"])
    part = lambda x, y: F.when(name(x) == name(y), 0.5 + 0.25 * mask_grade(x["t"]["subject"]["mask_2d"], y["t"]["subject"]["mask_2d"]) + 0.25 * mask_grade(x["t"]["object"]["mask_2d"], y["t"]["object"]["mask_2d"])).otherwise(0.0)
    score = lambda x: F.when(F.exists(g, lambda y: y["raw"] == x["raw"]), 1.0).otherwise(F.aggregate(g, F.lit(0.0), lambda a, y: F.greatest(a, part(x, y))))
    total = F.aggregate(F.transform(F.array_distinct(p), score), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.greatest(F.size(p), F.size(g)) > 0, total / F.greatest(F.size(p), F.size(g)))


def _most_often(items: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: x == y)))), F.lit(0))


def unrepeated(text: Column, most: int = 3) -> Column:
    """0 for a null text, or one that holds a mask over `most` times, else 1."""
    return F.when(text.isNull(), 0.0).otherwise((_most_often(_all(text, MASK)) <= most).cast("double"))


def unrepeated_triplets(text: Column, most: int = 2) -> Column:
    return (_most_often(_all(text, TRIPLET)) <= most).cast("double")


#: Sources of each way of scoring.
THINKING = ("thinking_res", "thinking_gres", "thinking_ver", "reasonseg")
PLAIN = ("padt_gcg", "dw_gcg", "res", "gres", "ver", "coconut_seg")


def reward(source: Column, text: Column, truth: Column) -> Column:
    """(overall, accuracy, format, no_repeat) by source; null for a source that isn't known."""
    score = lambda accuracy, form, once: F.struct((accuracy + form + once).alias("overall"), accuracy.alias("accuracy"), form.alias("format"), once.alias("no_repeat"))
    one = F.lit(1.0)
    thinking = score(mask_accuracy(answer(text), truth), well_formed(text), unrepeated(thought(text)) + unrepeated(answer(text)))
    caption = score(phrase_mask_accuracy(text, truth), phrase_accuracy(text, truth), unrepeated(text))
    return F.when(source.isin(*THINKING), thinking).when(source == "glamm_gcg", caption).when(source.isin(*PLAIN), score(mask_accuracy(text, truth), one, unrepeated(text))).when(source == "psg", score(triplet_accuracy(text, truth), one, unrepeated_triplets(text)))


#: What the coordinates of boxes mean.
BOX_FORMATS = ("yxyx_norm1000", "xyxy_norm1000", "xyxy_pixel")


def box_format(model: Column) -> Column:
    """The convention of a model's family."""
    m = F.lower(model)
    return F.when(F.startswith(m, F.lit("google/")) | m.contains("gemini"), "yxyx_norm1000").when(F.startswith(m, F.lit("qwen/")) | m.contains("qwen"), "xyxy_norm1000").otherwise("yxyx_norm1000")


def boxes(text: Column, width: Column, height: Column, form: Column) -> Column:
    """Boxes [x0, y0, x1, y1] in pixels of every [a, b, c, d] in a text. Values up to 1.5 are shares of one; xyxy values over
    1000 that fit the image are pixels; boxes are clipped and empty ones left out. Halves round to even."""
    raw = F.filter(F.transform(_all(text, r"\[([^\[\]]*)\]", 1), lambda x: F.transform(F.split(x, ","), lambda v: F.trim(v).try_cast("double"))), lambda v: (F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull()))

    def pixels(v: Column) -> Column:
        scaled = F.when((F.array_max(v) <= 1.5) & (form != "xyxy_pixel"), F.transform(v, lambda x: x * 1000)).otherwise(v)
        at = lambda i: F.element_at(scaled, i)
        x, y = (lambda i: F.rint(at(i) / 1000 * width).cast("int")), (lambda i: F.rint(at(i) / 1000 * height).cast("int"))
        plain = F.transform(scaled, lambda c: c.cast("int"))
        fits = (F.array_max(scaled) > 1000) & (at(1) < width * 1.1) & (at(3) < width * 1.1) & (at(2) < height * 1.1) & (at(4) < height * 1.1)
        box = F.when(form == "yxyx_norm1000", F.array(x(2), y(1), x(4), y(3))).when((form == "xyxy_norm1000") & ~fits, F.array(x(1), y(2), x(3), y(4))).otherwise(plain)
        clip = lambda i, top: F.greatest(F.lit(0), F.least(F.element_at(box, i), top))
        return F.array(clip(1, width - 1), clip(2, height - 1), clip(3, width), clip(4, height))

    return F.filter(F.transform(raw, pixels), lambda b: (F.element_at(b, 3) > F.element_at(b, 1)) & (F.element_at(b, 4) > F.element_at(b, 2)))


def tagged_caption(caption: Column, spans: Column) -> Column:
    """A caption with <p> and [SEG] around its spans (start, end), put in from right to left."""
    order = F.reverse(F.array_sort(spans))
    put = lambda c, s: F.concat(F.substring(c, F.lit(1), s["start"]), F.lit("<p> "), F.substring(c, s["start"] + 1, s["end"] - s["start"]), F.lit(" </p> [SEG]"), F.substring(c, s["end"] + 1, F.length(c)))
    return F.aggregate(order, caption, put)


def phrase_order(spans: Column) -> Column:
    """Phrases (start, end, phrase) by where they start."""
    return F.transform(F.array_sort(spans), lambda s: s["phrase"])


def phrase_position(caption: Column, phrase: Column) -> Column:
    """Place of the phrase in the lower-case caption, from 0; -1 if it isn't there."""
    return F.position(F.lower(phrase), F.lower(caption)) - 1


def object_numbers(text: Column) -> Column:
    return F.transform(_all(text, r"<obj(\d+)>", 1), lambda x: x.cast("int"))


def renumbered(text: Column) -> Column:
    """Object tags numbered anew from 1 by first occurrence, all at once, so that <obj1> and <obj10> don't mix."""
    tags = F.array_distinct(_all(text, r"<obj\d+>"))
    parts = F.split(text, r"(?=<obj\d+>)|(?<=>)")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^<obj\d+>$"), F.concat(F.lit("<obj"), F.array_position(tags, x).cast("string"), F.lit(">"))).otherwise(x)), "")


def content(text: Column, mark: str = "<image>") -> Column:
    """(kind, text) parts in order: an image before every part but the first, texts that aren't empty."""
    parts = F.split(text, mark, -1)
    each = F.transform(parts, lambda x, i: F.filter(F.array(F.struct(F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), (i > 0).alias("there")), F.struct(F.lit("text").alias("kind"), x.alias("text"), (x != "").alias("there"))), lambda y: y["there"]))
    return F.transform(F.flatten(each), lambda y: F.struct(y["kind"], y["text"]))


def interleaved(text: Column, images: Column) -> Column:
    """(kind, value) parts: images where <image> stands, in order while there are any; texts that aren't empty."""
    item = lambda kind, v, there: F.struct(F.lit(kind).alias("kind"), v.alias("value"), there.alias("there"))
    parts = F.transform(F.split(text, "<image>", -1), lambda x, i: F.filter(F.array(item("image", F.get(images, i - 1), (i > 0) & (i <= F.size(images))), item("text", x, x != "")), lambda y: y["there"]))
    return F.transform(F.flatten(parts), lambda y: F.struct(y["kind"], y["value"]))


def interleaved_by_number(text: Column, images: Column) -> Column:
    """The same where <image N> names the image; empty texts stay."""
    item = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    tail = lambda x: F.array(item("image", F.try_element_at(images, F.regexp_extract(x, r"^(\d)>", 1).try_cast("int"))), item("text", F.substring(x, 3, 1 << 30)))
    return F.flatten(F.transform(F.split(text, "<image ", -1), lambda x, i: F.when(i == 0, F.array(item("text", x))).otherwise(tail(x))))


def inverted(text: Column, prefix: str, suffix: str, frames: list[tuple[str, str]]) -> Column:
    """What a template put in: without prefix and suffix (if there), between the first frame that fits around something
    that isn't blank; null if none does."""
    s = F.trim(text)
    s = F.when(F.startswith(s, F.lit(prefix)), F.substring(s, len(prefix) + 1, 1 << 30)).otherwise(s)
    s = F.when(F.endswith(s, F.lit(suffix)), F.substring(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)
    out = F.lit(None).cast("string")
    for before, after in reversed(frames):
        middle = F.substring(s, F.lit(len(before) + 1), F.length(s) - len(before) - len(after))
        fits = F.startswith(s, F.lit(before)) & F.endswith(s, F.lit(after)) & (F.length(s) > len(before) + len(after)) & (F.trim(middle) != "")
        out = F.when(fits, middle).otherwise(out)
    return out


def objects_in(text: Column) -> Column:
    """Flat JSON objects written in a text, as maps of strings."""
    return F.filter(F.transform(_all(text, r"\{[^{}]*\}"), lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())


def one_object(text: Column) -> Column:
    """The one JSON object of a text; else, after its only brace, lines of `key: value` without outer quotes and commas."""
    found = objects_in(text)
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^[,"']+|[,"']+$""", "")
    lines = F.filter(F.split(F.substring_index(text, "{", -1), "\n"), lambda x: x.contains(": "))
    pairs = F.transform(lines, lambda x: F.struct(bare(F.element_at(F.split(x, ": "), 1)).alias("k"), bare(F.element_at(F.split(x, ": "), 2)).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).when(F.size(F.split(text, r"\{", -1)) == 2, F.map_from_entries(last))


def chinese(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def as_list(text: Column) -> Column:
    """A JSON list of strings as an array, any other text as an array of one."""
    return F.coalesce(F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, "array<string>")), F.array(text))


def prompt(question: Column, options: list[tuple[str, Column]], hint: Column | None = None) -> Column:
    """Question and lettered options, those that are null left out, under an optional hint."""
    lines = [F.concat(F.lit("Hint: "), hint) if hint is not None else F.lit(None).cast("string"), F.concat(F.lit("Question: "), question)]
    return F.concat_ws("\n", *lines, *(F.concat(F.lit(f"{k}. "), v) for k, v in options), F.lit("Answer: "))


def caption_fits(caption: Column, width: Column, height: Column, words: int = 3, side: int = 32) -> Column:
    """At least so many words, and so many pixels on the shorter side."""
    return (F.size(F.split(caption, " ")) >= words) & (F.least(width, height) >= side)
