"""Spellings typed by people, linked to the humans they mean.

Tokens of all distinct spellings are compared first: MinHash banding over padded q-grams brings similar tokens together (bands and
rows are chosen from the collision curve for a wanted recall), an edit distance of one confirms a slip, and star clustering puts rare
tokens under the frequent one they are a slip of. Tokens of three or four letters are too alike for that; they are compared within whole
padded names, by the same banding and stars, where the other name must be the same. Members of a band meet through the strings that are
left when a letter is taken out, so a band costs no pairs; bands of many members are parted by these strings. Which token of a spelling is the family name follows from where its star stands in all
other spellings. Spellings with both names are the stars of the second level: one human for each family and given name. Initials,
short forms and fused logins join the one star of their family that they can mean, by equi-joins on (family, initial), (family,
full form) and the like; where several fit, a middle initial or an alias of an entity decides, else nothing is linked. Every link
is confirmed by Monge-Elkan similarity of the tokens; but what a row of aliases itself says of a spelling without a name in it (a login) needs no
likeness. Small words (van der, de la) are part of the name behind them, and names may have any number of words.

All steps work on distinct spellings, so frequent ones cost nothing. Null, empty and nameless spellings and bots link to nothing. Repeated rows
count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import Cut, bounded

# Short forms and the given names they stand for; a parameter of the operator.
SHORT_FORMS = {
    "alex": "alexander alexandra alexis", "sasha": "alexander alexandra", "xander": "alexander", "al": "albert alexander alan", "bea": "beatrice beatrix", "trixie": "beatrice beatrix", "ben": "benjamin benedict", "benji": "benjamin",
    "cathy": "catherine", "kate": "catherine katherine katarzyna", "katie": "catherine katherine", "cat": "catherine", "kit": "christopher catherine", "chris": "christopher christian christine christina", "topher": "christopher", "dan": "daniel", "danny": "daniel", "dora": "dorothea theodora",
    "thea": "dorothea theodora", "dot": "dorothea", "dottie": "dorothea", "ed": "edward edmund edgar", "eddie": "edward edmund", "ted": "edward theodore", "ned": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "liesel": "elisabeth elizabeth anneliese",
    "frank": "francisco francis", "paco": "francisco", "pancho": "francisco", "cisco": "francisco", "rike": "frederike ulrike", "freddie": "frederike frederick", "fritzi": "frederike", "gabi": "gabriela gabriele", "gaby": "gabriela", "greg": "gregory", "grisha": "gregory", "heinz": "heinrich", "heiner": "heinrich", "harry": "henry harold heinrich", "etta": "henrietta", "hettie": "henrietta", "hatty": "henrietta",
    "nacho": "ignacio", "iggy": "ignacio", "bella": "isabella", "izzy": "isabella", "isa": "isabella", "jon": "jonathan", "nathan": "jonathan nathaniel", "jo": "josephine joseph joanna", "josie": "josephine", "posy": "josephine", "kasia": "katarzyna", "kostya": "konstantin", "stan": "konstantin stanislav", "leo": "leonardo leonard leopold", "nardo": "leonardo", "lucy": "lucinda", "cindy": "lucinda cynthia", "lou": "lucinda louise louis",
    "grete": "margarethe", "gretel": "margarethe", "greta": "margarethe", "maggie": "margarethe margaret", "meg": "margarethe margaret", "mike": "michael", "mick": "michael", "misha": "michael mikhail", "micha": "michael", "nat": "nathaniel natalia natalie", "nate": "nathaniel", "talia": "natalia", "natasha": "natalia", "tavi": "octavia octavio", "tavia": "octavia", "ollie": "oliver olivia", "noll": "oliver", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia",
    "pete": "peter pyotr", "petya": "pyotr", "quin": "quentin quirina", "rina": "quirina katarina", "rich": "richard", "rick": "richard", "dick": "richard", "rosa": "rosalind", "ros": "rosalind", "roz": "rosalind", "sam": "samantha samuel", "sammy": "samantha samuel", "bastian": "sebastian", "seb": "sebastian", "theo": "theodore", "tess": "theresa", "tessa": "theresa", "terry": "theresa terence", "resi": "theresa", "ulli": "ulrike ulrich", "uli": "ulrike ulrich", "umber": "umberto", "berto": "umberto roberto alberto",
    "vicky": "victoria", "tori": "victoria", "vic": "victor victoria", "vlad": "vladimir", "volodya": "vladimir", "vova": "vladimir", "mina": "wilhelmina", "minna": "wilhelmina", "willa": "wilhelmina", "will": "william", "bill": "william", "billy": "william", "liam": "william", "mena": "ximena", "xime": "ximena", "xavi": "xavier", "zhenya": "yevgeny", "gene": "yevgeny eugene", "yoli": "yolanda", "lana": "yolanda svetlana", "zach": "zachary", "zack": "zachary", "anneliese": "annelise", "bob": "robert", "rob": "robert", "jim": "james", "tom": "thomas", "tony": "anthony antonia", "andy": "andrew andrea", "joe": "joseph", "jack": "john", "sue": "susan", "tim": "timothy", "matt": "matthew", "max": "maximilian", "steve": "stephen steven", "nick": "nicholas", "ann": "anna", "jenny": "jennifer", "teddy": "theodore edward", "peggy": "margarethe margaret", "billie": "wilhelmina william", "hetty": "henrietta", "hatti": "henrietta", "rosie": "rosalind", "fran": "francisco frances", "ela": "gabriela isabella michaela", "zuza": "zuzanna", "zuzia": "zuzanna", "anne": "anneliese annelise anna",
}
# Small words of family names.
PARTICLES = set("af al da das de dei del della den der di do dos du el la las le los ten ter van vom von zu zum zur".split())
Q = 2
WANTED, AT = 0.97, 0.42
#: Two names of which one is short are this alike at least.
WHOLE_AT = 0.5
SHORT = 5
#: Members of a band that one task takes; larger ones are parted.
BAND = 20_000


def curve(bands: int, rows: int, s: float) -> float:
    """The chance that two sets of Jaccard similarity s share a band."""
    return 1 - (1 - s**rows) ** bands


def banding(wanted: float = WANTED, at: float = AT, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective setting that finds pairs of similarity `at` with at least the wanted chance."""
    best = (most, 1)
    for rows in range(1, 9):
        bands = next((b for b in range(1, most // rows + 1) if curve(b, rows, at) >= wanted), None)
        if bands:
            best = (bands, rows)
    return best


def fold(text: str) -> str:
    text = text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def parse(raw: str) -> dict:
    """words (folded), initials, whether a comma puts the family name first, and whether the spelling is a login."""
    text = (raw or "").strip()
    named = re.match(r"^(.*?)\s*<[^>]*>\s*$", text)
    if named and named[1]:
        text = named[1].strip().strip('"')
    login = not re.search(r"\s", text)
    if "@" in text and login:
        text = text.split("@")[0].lstrip("<").split("+")[0]
    comma = "," in text
    words, initials = [], []
    if login and not comma:
        for t in re.split(r"[._\-]+", fold(text)):
            t = re.sub(r"\d+$", "", t)
            if re.fullmatch(r"[^\W\d_]+", t or ""):
                (words if len(t) > 1 else initials).append(t)
            elif t:
                words = []
                break
        return {"words": words, "initials": initials, "comma": False, "login": True}
    pieces = [p for p in re.split(r"[\s,]+", text) if p]
    caps = all(p.isupper() for p in pieces if len(p) > 2)
    for p in pieces:
        letters = re.sub(r"[.'’]", "", p)
        if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?", p) or len(letters) == 1 or (len(letters) == 2 and letters.isupper() and not caps):
            initials += list(fold(letters))
        elif re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", letters):
            words.append(fold(letters))
        else:
            words = []
            break
    return {"words": joined(words, comma), "initials": initials, "comma": comma, "login": False}


def joined(words: list[str], comma: bool) -> list[str]:
    """Small words written together with the word behind them; the first word is one only if the family name comes first."""
    out, held = [], ""
    for i, w in enumerate(words):
        if w in PARTICLES and i + 1 < len(words) and (i or comma):
            held += w
        else:
            out.append(held + w)
            held = ""
    return out


def is_bot(words: list[str]) -> bool:
    return "bot" in words


def slip(a: str, b: str) -> bool:
    """One letter more, less or different, or two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, m = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                m.append(c)
                break
    if not m:
        return 0.0
    n = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(m, n)) / 2
    k = len(m)
    jaro = (k / len(a) + k / len(b) + (k - t) / k) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + 0.1 * p * (1 - jaro)


def alike(x: str, y: str, short_forms: dict[str, str] = SHORT_FORMS) -> float:
    """Inner similarity: an initial or a short form counts as the name it stands for."""
    if len(x) == 1 or len(y) == 1:
        return 1.0 if x[0] == y[0] else 0.0
    if y in short_forms.get(x, "").split() or x in short_forms.get(y, "").split():
        return 1.0
    if min(len(x), len(y)) >= 3 and (x.startswith(y[:2]) or y.endswith(x[-3:]) or x.endswith(y[-3:])) and min(len(x), len(y)) <= 6:
        return max(0.9, jaro_winkler(x, y)) if len(x) != len(y) else jaro_winkler(x, y)
    return jaro_winkler(x, y)


def monge_elkan(a: list[str], b: list[str], short_forms: dict[str, str] = SHORT_FORMS) -> float:
    """Mean over the tokens of the first of their best match in the second."""
    return sum(max(alike(x, y, short_forms) for y in b) for x in a) / len(a) if a and b else 0.0


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for s in pdf["spelling"]:
            p = parse(s)
            if p["words"] and not is_bot(p["words"]):
                rows.append((s, p["words"], p["initials"], p["comma"], p["login"]))
        yield pd.DataFrame(rows, columns=["spelling", "words", "initials", "comma", "login"])


def _bands(bands: int, rows: int):
    rng = np.random.default_rng(17)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, n in zip(pdf["token"], pdf["n"]):
                p = f"#{t}#"
                g = np.array([hash_text(p[i : i + Q]) for i in range(len(p) - Q + 1)], np.uint64)
                h = g[:, None] * a + b
                low = (h ^ (h >> np.uint64(29))).min(0).reshape(bands, rows)
                key = np.zeros(bands, np.uint64)
                for r in range(rows):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + low[:, r] + np.uint64(r)
                key = key * np.uint64(bands + 1) + np.arange(bands, dtype=np.uint64)
                out += [(k, t, n) for k in key.astype(np.int64).tolist()]
            yield pd.DataFrame(out, columns=["key", "token", "n"])

    return run


def hash_text(t: str) -> int:
    h = 1469598103934665603
    for c in t:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def shortened(t: str) -> set[str]:
    """The string and all it becomes by taking one letter out: two strings that are slips of each other share one."""
    return {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}


def name_slip(a: str, b: str) -> bool:
    """Whole names "family|given" of which one part is the same and the other, a short one, a slip."""
    x, y = a.split("|"), b.split("|")
    return len(x) == len(y) == 2 and any(x[1 - i] == y[1 - i] and 3 <= min(len(x[i]), len(y[i])) < SHORT and slip(x[i], y[i]) for i in (0, 1))


def _slips(test: Callable[[str, str], bool], skip: frozenset) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Strings of one band key after the other -> (token, n, star, m): a slip and the more frequent string it may be one of."""

    def close(held: dict[str, int]) -> pd.DataFrame:
        rows, met = [], {}
        for t in held:
            for v in shortened(t):
                met.setdefault(v, []).append(t)
        for group in met.values():
            if len(group) < 2:
                continue
            # the frequent ones first: only they can be stars
            group.sort(key=lambda t: (-held[t], t))
            for t in group:
                if t in skip:
                    continue
                # a name of a few spellings is one slip more easily than one of many, which only a far more frequent one may take over
                n = held[t]
                least = 2 * n if n <= 4 else 5 * n
                for u in group:
                    if held[u] < least:
                        break
                    if u != t and test(t, u):
                        rows.append((t, n, u, held[u]))
        return pd.DataFrame(rows, columns=["token", "n", "star", "m"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for pdf in batches:
            for k, t, n in zip(pdf["key"].tolist(), pdf["token"].tolist(), pdf["n"].tolist()):
                if k != now:
                    if len(held) > 1:
                        yield close(held)
                    now, held = k, {}
                held[t] = n
        if len(held) > 1:
            yield close(held)

    return run


def _parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, token, n) of large bands, once under each string the token is left with when a letter is taken out."""
    for pdf in batches:
        rows = [(hash_text(v) ^ k & 0x7FFFFFFFFFFFFFFF, t, n) for k, t, n in zip(pdf["key"].tolist(), pdf["token"].tolist(), pdf["n"].tolist()) for v in shortened(t)]
        yield pd.DataFrame([((k + 2**63) % 2**64 - 2**63, t, n) for k, t, n in rows], columns=["key", "token", "n"])


def stars(tokens: DataFrame, wanted: float = WANTED, at: float = AT, test: Callable[[str, str], bool] = slip, skip: frozenset = frozenset(SHORT_FORMS), band: int = BAND) -> DataFrame:
    """(token, star) for every token (token, n: distinct spellings): itself, or the frequent token it is a slip of."""
    bands, rows = banding(wanted, at)
    tasks = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # few rows, much work: numbers of tasks of their own, which adaptive execution leaves alone
    spread = tokens.filter(F.length("token") >= SHORT).select("token", F.col("n").cast("long").alias("n")).repartition(tasks)
    keyed = spread.mapInPandas(_bands(bands, rows), "key long, token string, n long")
    keyed = Cut(keyed, "bands")
    large = bounded(Cut(keyed.df.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > band).select("key"), "large").df)
    parted = keyed.df.join(large, "key", "left_semi").mapInPandas(_parted, "key long, token string, n long")
    every = keyed.df.join(large, "key", "left_anti").unionByName(parted)
    slips = every.repartition(tasks, "key").sortWithinPartitions("key").mapInPandas(_slips(test, skip), "token string, n long, star string, m long").distinct()
    best = Cut(slips.groupBy("token").agg(F.max_by("star", F.struct("m", "star")).alias("star")), "slips").df
    keyed.drop()
    # a star is nobody's slip
    sound = best.join(best.select(F.col("token").alias("star")), "star", "left_anti")
    return tokens.select("token").join(sound, "token", "left").select("token", F.coalesce("star", "token").alias("star"))


def _confirmed(short_forms: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for w, i, family, given in zip(pdf["words"], pdf["initials"], pdf["family"], pdf["given"]):
                w = list(w)
                human = [family, given or family]
                fit = monge_elkan(w or list(i)[:1], human, short_forms) if len(w) < 3 else sum(sorted((max(alike(x, y, short_forms) for y in human) for x in w), reverse=True)[:2]) / 2
                if len(w) == 1 and not len(i) and len(w[0]) > 2:  # an initial and the family name in one word
                    fit = max(fit, monge_elkan([w[0][:1], w[0][1:]], [given or family, family], short_forms))
                ok.append(fit >= 0.8)
            yield pdf[ok][["spelling", "human"]]

    return run


def identify(spellings: DataFrame, aliases: DataFrame, short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """(spelling, human) for distinct spellings that can be told; aliases: (alias, spelling of the entity it is an alias of).

    short_forms: short form -> the given names it stands for, between blanks; may be empty.
    """
    short_forms = short_forms or {"": ""}
    parsed = Cut(spellings.filter("spelling is not null").distinct().mapInPandas(_parsed, "spelling string, words array<string>, initials array<string>, comma boolean, login boolean"), "parsed").df
    placed = parsed.select("spelling", "comma", "initials", F.size("words").alias("k"), "login", F.posexplode("words").alias("pos", "token"))
    # votes of unmarked two-word spellings, of commas and of initials: is a token a given or a family name?
    first = F.when(F.col("comma"), F.lit(3) * (F.col("pos") == 1).cast("int")).otherwise((F.col("pos") == 0).cast("int"))
    last = F.when(F.col("comma"), F.lit(3) * (F.col("pos") == 0).cast("int")).otherwise((F.col("pos") == F.col("k") - 1).cast("int"))
    two = F.col("k") >= 2
    lone = (F.col("k") == 1) & (F.size("initials") > 0)
    votes = placed.groupBy("token").agg(F.countDistinct("spelling").alias("n"), F.sum(F.when(two, first).otherwise(0)).alias("g"), F.sum(F.when(two, last).when(lone, 2).otherwise(0)).alias("f"))
    votes = Cut(votes, "votes").df
    star = stars(votes.select("token", "n"), skip=frozenset(short_forms))
    known = {y for x in short_forms.values() for y in x.split()} | set(short_forms)
    summed = votes.join(star, "token").groupBy("star").agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    lean = (F.col("g") - F.col("f")) / (F.col("g") + F.col("f") + 1) + F.when(F.col("star").isin(sorted(known)), 3).otherwise(0)
    roles = Cut(star.join(summed.select("star", lean.alias("lean")), "star").select("token", "star", "lean"), "roles").df
    tokens = placed.join(roles, "token")
    w = Window.partitionBy("spelling")
    # the family name leans away from given names most; ties go by place
    tie = F.when(F.col("comma"), F.col("pos")).otherwise(-F.col("pos"))
    ordered = tokens.withColumn("r", F.row_number().over(w.orderBy("lean", tie)))
    forms = ordered.groupBy("spelling").agg(
        F.max(F.when(F.col("r") == 1, F.col("star"))).alias("family"),
        F.max(F.when((F.col("r") == F.col("k")) & (F.col("k") > 1), F.col("star"))).alias("given"),
        F.max("k").alias("k"),
        F.max("token").alias("raw"),
        F.max(F.col("login").cast("int")).alias("login"),
        F.first("initials").alias("initials"),
    )
    initial = lambda i: F.when(F.size("initials") >= i, F.element_at("initials", i))
    forms = forms.select("spelling", "family", "given", "k", "raw", "login", F.when(F.col("given").isNull(), initial(1)).alias("letter"), F.when(F.col("given").isNull(), initial(2)).otherwise(initial(1)).alias("middle"), F.coalesce(F.col("given").isin([k for k, v in short_forms.items() if v]) | ((F.length("given") <= 4) & ~F.col("given").isin(sorted(known))), F.lit(False)).alias("is_short"))
    forms = Cut(forms, "forms").df
    full = forms.filter("given is not null and not is_short").groupBy("family", "given").agg(F.count(F.lit(1)).alias("n"))
    # short names, by whole names
    small = f"length(family) < {SHORT} or length(given) < {SHORT}"
    whole = F.concat_ws("|", "family", "given")
    moved = Cut(stars(full.select(whole.alias("token"), "n"), at=WHOLE_AT, test=name_slip, skip=frozenset()).filter("token <> star"), "names").df
    part = lambda i: F.element_at(F.split("star", "\\|"), i)
    forms = forms.withColumn("token", F.when(F.expr(small), whole)).join(moved, "token", "left")
    forms = forms.withColumn("family", F.coalesce(part(1), "family")).withColumn("given", F.when(F.col("star").isNotNull(), part(2)).otherwise(F.col("given"))).drop("token", "star")
    forms = Cut(forms, "forms").df
    full = forms.filter("given is not null and not is_short").select("family", "given").distinct()
    seen = votes.filter("f > 0").select("token").join(roles, "token").select("star").distinct()
    humans = Cut(full.select("family", "given", F.concat_ws("|", "family", "given").alias("human")), "humans").df
    middles = forms.filter("given is not null and middle is not null").select("family", "given", "middle").distinct().select(F.concat_ws("|", "family", "given").alias("human"), F.col("middle").alias("m"))

    sure = forms.filter("given is not null and not is_short").select("spelling", F.concat_ws("|", "family", "given").alias("human"))
    # one star each: by full form, by likeness of a short form the list lacks, by initial, by fused initial and family
    fulls = F.split(F.element_at(F.create_map(*[F.lit(x) for p in short_forms.items() for x in p]), F.col("given")), " ")
    shorts = forms.filter("is_short").select("spelling", "family", "middle", F.explode(fulls).alias("given"), F.lit(1).alias("way"))
    by_form = shorts.join(humans, ["family", "given"]).select("spelling", "human", "middle", "way")
    letters = forms.filter("given is null and letter is not null").select("spelling", "family", F.col("letter").alias("l"), "middle", F.lit(2).alias("way"))
    fused = forms.filter("k = 1 and given is null and letter is null and login = 1 and length(raw) > 4")
    # of the login as typed: with its initial it looks like a slip of the family name
    fused = fused.select("spelling", F.substring("raw", 2, 99).alias("token"), F.substring("raw", 1, 1).alias("l")).join(roles.select("token", "star"), "token").join(seen, "star").select("spelling", F.col("star").alias("family"), "l", F.lit(None).cast("string").alias("middle"), F.lit(2).alias("way"))
    by_letter = letters.unionByName(fused).join(humans.withColumn("l", F.substring("given", 1, 1)), ["family", "l"]).select("spelling", "human", "middle", "way")
    # a short form without a full form that fits may still be cut from one: same beginning, or same end
    left = forms.filter("is_short").join(by_form.select("spelling").distinct(), "spelling", "left_anti")
    cut = lambda df, c: df.withColumn("c", F.explode(F.array(F.concat(F.lit("^"), F.substring(c, 1, 2)), F.concat(F.substring(c, -3, 3), F.lit("$")))))
    by_cut = cut(left, "given").drop("given").join(cut(humans, "given"), ["family", "c"]).select("spelling", "human", "middle", F.lit(3).alias("way")).distinct()
    met = Cut(by_form.unionByName(by_letter).unionByName(by_cut).distinct(), "met").df
    by_middle = met.join(middles, "human", "left").withColumn("fits", (F.col("middle") == F.col("m")).cast("int"))
    per = Window.partitionBy("spelling")
    rated = by_middle.groupBy("spelling", "human").agg(F.max(F.coalesce("fits", F.lit(0))).alias("fits"))
    rated = rated.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("fit", F.sum("fits").over(per))
    one = rated.filter("n = 1 or (fit = 1 and fits = 1)").select("spelling", "human")
    # several fit, or none: what the entity's aliases say, then a star of its own
    told = Cut(sure.unionByName(one), "told").df
    said = aliases.join(told, "spelling").groupBy(F.col("alias").alias("spelling")).agg(F.collect_set("human").alias("hs"))
    said = said.filter(F.size("hs") == 1).select("spelling", F.element_at("hs", 1).alias("human")).join(told.select("spelling"), "spelling", "left_anti")
    # and the other way: an entity whose own spelling is open, by the aliases it has
    more = Cut(told.unionByName(said), "told").df
    back = aliases.join(more.withColumnRenamed("spelling", "alias"), "alias").groupBy("spelling").agg(F.collect_set("human").alias("hs"))
    back = back.filter(F.size("hs") == 1).select("spelling", F.element_at("hs", 1).alias("human")).join(more.select("spelling"), "spelling", "left_anti")
    all_ = Cut(more.unionByName(back), "told").df
    own = forms.filter("given is not null or letter is not null").join(all_.select("spelling"), "spelling", "left_anti").join(met.select("spelling").distinct(), "spelling", "left_anti")
    own = own.select("spelling", F.concat_ws("|", "family", F.coalesce("given", "letter")).alias("human"))
    linked = all_.unionByName(own)
    # Monge-Elkan of the spelling's tokens against its star's; aliases without tokens of a name were told by their entity
    by_alias = linked.join(said.unionByName(back), ["spelling", "human"], "left_semi")
    check = linked.join(by_alias.select("spelling"), "spelling", "left_anti").join(parsed.select("spelling", "words", "initials"), "spelling")
    check = check.select("spelling", "human", "words", "initials", F.element_at(F.split("human", "\\|"), 1).alias("family"), F.element_at(F.split("human", "\\|"), 2).alias("given"))
    return Cut(check.mapInPandas(_confirmed(short_forms), "spelling string, human string").unionByName(by_alias), "linked").df


def _people(entities: DataFrame, aliases: DataFrame, actors: DataFrame, short_forms: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(id, spelling, human) of entities and (actor, human) of actors whose human can be told."""
    people = Cut(entities.filter("id is not null and name is not null").select("id", F.col("name").alias("spelling")).distinct(), "people").df
    said = aliases.filter("alias is not null").join(people.withColumnRenamed("id", "entity_id"), "entity_id").select("alias", "spelling").distinct()
    said = Cut(said, "said").df
    distinct_actors = actors.filter("actor is not null").select(F.col("actor").alias("spelling")).distinct()
    spellings = people.select("spelling").union(said.select("alias")).union(distinct_actors)
    human = identify(spellings, said, short_forms)
    owned = Cut(people.join(human, "spelling").select("id", "spelling", "human").distinct(), "owned").df
    return owned, distinct_actors.join(human, "spelling").select(F.col("spelling").alias("actor"), "human")


def person_classes(entities: DataFrame, aliases: DataFrame, actors: DataFrame, short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """(kind: entity or actor, key, human, n_links): each member with its class and the number of other members, without any pairs."""
    owned, acted = _people(entities, aliases, actors, short_forms)
    members = owned.select(F.lit("entity").alias("kind"), F.col("id").alias("key"), "human").unionByName(acted.select(F.lit("actor").alias("kind"), F.col("actor").alias("key"), "human")).distinct()
    sizes = members.groupBy("human").agg((F.count(F.lit(1)) - 1).alias("n_links")).withColumnRenamed("human", "h")
    return salted_join(members, sizes, "human", "h", "inner")


def link_people(entities: DataFrame, aliases: DataFrame, actors: DataFrame, short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """(link_kind, left_key, right_key): entity pairs of one human, and actors with the entities of their human.

    entities: (id, name) of persons; aliases: (entity_id, alias); actors: (actor). A human of many rows has as many pairs as
    the result asks for; person_classes gives classes instead.
    """
    owned, acted = _people(entities, aliases, actors, short_forms)
    mine = owned.select("human", F.col("id").alias("left_key")).distinct()
    theirs = owned.select(F.col("human").alias("h"), F.col("id").alias("right_key")).distinct()
    pairs = salted_join(mine, theirs, "human", "h", "inner").filter("left_key < right_key").select(F.lit("entity_entity").alias("link_kind"), "left_key", "right_key")
    theirs = owned.select(F.col("human").alias("h"), "spelling", F.col("id").alias("right_key"))
    named = salted_join(acted, theirs, "human", "h", "inner").filter("actor <> spelling")
    return pairs.unionByName(named.select(F.lit("actor_entity").alias("link_kind"), F.col("actor").alias("left_key"), "right_key")).distinct()
