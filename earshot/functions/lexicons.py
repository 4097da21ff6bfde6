"""Default word lists; every operator takes its lists as parameters, and ``read_lexicon`` and ``read_taxonomy`` read larger ones from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that turn a phrase within three words behind them. They must equal those of the measures reproduced here.
NEGATORS = [
    "no", "not", "never", "without", "none", "neither", "nor", "reduced", "mitigated", "eliminated", "resolved", "avoided", "overcame", "addressed", "managed", "minimized", "offset", "despite", "notwithstanding",
    "regardless", "absent",
]
#: Words that raise a phrase's severity. Fixed values, as above.
INTENSIFIERS = [
    "significant", "significant impact", "major", "severe", "critical", "substantial", "considerable", "dramatic", "unprecedented", "extreme", "alarming", "acute", "intensifying", "escalating", "mounting", "profound",
    "massive", "enormous", "devastating", "serious", "outsized", "meaningful", "material", "notable", "marked",
]
#: Words that lower it. Fixed values, as above.
DIMINISHERS = [
    "minor", "slight", "marginal", "modest", "limited", "manageable", "contained", "moderate", "small", "minimal", "negligible", "immaterial", "temporary", "transient", "short-lived", "stabilizing", "improving", "recovering",
    "normalizing", "easing",
]

#: Risk phrases written for this project under the ten category names of the measures reproduced here (fixed values).
#: They name what calls talk about; a user's own taxonomy is read with ``read_taxonomy``.
RISKS: dict[str, list[str]] = {
    "demand_risk": ["renewals slipped", "orders slipped", "bookings declined", "trimming shelf stock", "customers pulling deliveries forward", "longer approval cycles", "mild weather", "churn", "store traffic", "weaker replacement cycle"],
    "margin_risk": ["freight expense", "scrap rates", "energy tariffs", "expedited shipping fees", "warranty expense", "low-margin contract", "discount", "rebate timing", "unit cost"],
    "supply_chain_risk": ["port congestion", "sole-source vendor", "delivery times", "shortage", "delays", "slower permits", "closed the site", "channel inventory"],
    "regulatory_risk": ["regulatory", "tax settlement", "recall", "permit", "auditor", "fine", "probe"],
    "competition_risk": ["competitors cutting list prices", "competitor", "lose share", "list prices", "trade-in offer"],
    "fx_macro_risk": ["currency", "local currency", "inflation", "interest rate", "recession", "slow economy"],
    "liquidity_risk": ["net debt", "term loan", "lenders", "working capital", "covenant", "days outstanding", "took a charge"],
    "tech_execution_risk": ["old mainframe", "migration", "integration", "rollout", "behind where we want it", "outage", "break-even"],
    "labor_risk": ["wage agreements", "trained drivers", "paused hiring", "headcount", "night shift", "strike"],
    "geopolitical_risk": ["tariffs", "tariff holiday", "trade war", "war", "sanctions", "embargo", "border closure"],
}


def verb_forms(verb: str) -> list[str]:
    """A regular verb with its other forms: decline, declines, declined, declining."""
    if verb.endswith("e"):
        return [verb, verb + "s", verb + "d", verb[:-1] + "ing"]
    if verb.endswith("y") and verb[-2] not in "aeiou":
        return [verb, verb[:-1] + "ies", verb[:-1] + "ied", verb + "ing"]
    return [verb, verb + ("es" if verb.endswith(("s", "x", "ch", "sh")) else "s"), verb + "ed", verb + "ing"]


def adverb_forms(adjective: str) -> list[str]:
    """An adjective and its adverb: weak, weakly; noisy, noisily; stable, stably."""
    return [adjective, adjective[:-1] + "ily" if adjective.endswith("y") else adjective[:-1] + "y" if adjective.endswith("le") else adjective + "ally" if adjective.endswith("ic") else adjective + "ly"]


def noun_forms(noun: str) -> list[str]:
    """A noun and its plural: loss, losses; penalty, penalties."""
    return [noun, noun[:-1] + "ies" if noun.endswith("y") and noun[-2] not in "aeiou" else noun + ("es" if noun.endswith(("s", "x", "ch", "sh")) else "s")]


def word_forms(verbs: list[str] = (), adjectives: list[str] = (), nouns: list[str] = (), others: list[str] = ()) -> list[str]:
    """All forms of a few base words, each once, in order."""
    every = [f for base, forms in ((verbs, verb_forms), (adjectives, adverb_forms), (nouns, noun_forms)) for w in base for f in forms(w)]
    return list(dict.fromkeys([*every, *others]))


#: Base words of the sentiment lists, chosen for this project; the lists hold all their regular forms.
POSITIVE = word_forms(
    verbs=[
        "accelerate", "improve", "expand", "rebound", "recover", "stabilize", "strengthen", "gain", "benefit", "achieve", "advance", "boost", "deliver", "enable", "enhance", "exceed", "innovate", "lift", "outperform", "outpace",
        "progress", "prosper", "reward", "succeed", "surpass", "thrive", "brighten", "energize", "delight", "earn", "invigorate", "perfect", "please", "regain", "resolve", "restore", "simplify", "smooth", "unlock", "upgrade",
    ],
    adjectives=["strong", "bright", "comfortable", "confident", "profitable", "favorable", "efficient", "attractive", "exceptional", "excellent", "impressive", "positive", "robust", "solid", "steady", "successful", "superb", "valuable", "healthy", "productive", "constructive", "enthusiastic", "smart", "sound", "vibrant"],
    nouns=["opportunity", "strength", "success", "record", "gain", "improvement", "achievement", "breakthrough", "upside", "innovation", "milestone", "win", "tailwind", "advantage", "accomplishment"],
    others=["stronger", "strongest", "better", "best", "growth", "grew", "ahead", "leadership", "momentum", "optimism", "optimistic", "higher-than-expected", "larger", "won"],
)
NEGATIVE = word_forms(
    verbs=[
        "decline", "lag", "contract", "soften", "weaken", "delay", "lose", "miss", "threaten", "close", "abandon", "abuse", "accuse", "aggravate", "allege", "annoy", "bankrupt", "breach", "burden", "cancel", "cease", "collapse", "complain", "complicate",
        "concede", "confuse", "corrupt", "crash", "criticize", "damage", "decay", "default", "defend", "defraud", "degrade", "demolish", "deplete", "depress", "deteriorate", "devalue", "disappoint", "discontinue", "disrupt", "dissolve", "distort", "disturb",
        "divest", "doubt", "downgrade", "downsize", "erode", "err", "evade", "exacerbate", "exhaust", "expose", "fail", "falter", "fine", "force", "foreclose", "forfeit", "halt", "hamper", "harass", "harm", "hinder", "hurt", "idle", "impair", "impede", "injure",
        "interrupt", "jeopardize", "liquidate", "malfunction", "misstate", "mistake", "neglect", "object", "obstruct", "offend", "overcharge", "overstate", "penalize", "plunge", "postpone", "protest", "punish", "question", "recall", "recess", "reject", "relinquish",
        "resign", "restate", "restructure", "retaliate", "sacrifice", "scrutinize", "seize", "shrink", "shutter", "slow", "slump", "squeeze", "stagnate", "strain", "struggle", "stress", "suffer", "suspend", "tarnish", "terminate", "trouble", "undermine",
        "underperform", "violate", "vitiate", "void", "warn", "waste", "withdraw", "worry", "worsen", "writedown",
    ],
    adjectives=[
        "weak", "weaker", "late", "adverse", "difficult", "worthless", "lumpy", "bad", "careless", "costly", "cumbersome", "dangerous", "deficient", "detrimental", "disadvantageous", "erroneous", "excessive", "fraudulent", "grave", "harsh", "hostile", "idle", "ill", "illegal", "illicit",
        "improper", "inadequate", "inaccurate", "incomplete", "inefficient", "insolvent", "insufficient", "negative", "negligent", "noisy", "obsolete", "onerous", "poor", "problematic", "reckless", "serious", "severe", "sharp", "sluggish", "stagnant", "stringent", "turbulent",
        "unable", "unexpected", "unfair", "unfavorable", "unprofitable", "unreliable", "unstable", "unsuccessful", "unusual", "unwanted", "vulnerable",
    ],
    nouns=[
        "loss", "shortage", "threat", "charge", "headwind", "pressure", "shortfall", "weakness", "bottleneck", "challenge", "conflict", "crisis", "deficit", "dispute", "downturn", "emergency", "error", "failure", "fault", "fear", "fraud", "grievance", "impairment", "investigation", "lapse",
        "layoff", "liability", "litigation", "obstacle", "outage", "penalty", "problem", "recession", "risk", "scandal", "setback", "shutdown", "slowdown", "slippage", "theft", "tragedy", "volatility", "writeoff", "wrongdoing",
    ],
    others=["slipped", "slipping", "lagged", "lagging", "trimmed", "behind", "missing", "lower", "slower", "congestion", "lost", "losing", "worse", "worst", "unusually"],
)
UNCERTAIN = word_forms(
    verbs=["appear", "assume", "believe", "depend", "deviate", "fluctuate", "hesitate", "imply", "predict", "presume", "reconsider", "seem", "speculate", "suggest", "vary"],
    adjectives=["approximate", "arbitrary", "careful", "conceivable", "conditional", "indefinite", "likely", "possible", "preliminary", "probable", "random", "rough", "rare", "sporadic", "sudden", "tentative", "uncertain", "unclear", "unpredictable", "vague", "volatile", "imprecise", "broad"],
    nouns=["anomaly", "assumption", "contingency", "doubt", "exposure", "possibility", "probability", "uncertainty", "variability", "variance", "guess", "risk"],
    others=["about", "almost", "around", "could", "may", "maybe", "might", "nearly", "perhaps", "somewhat", "sometimes", "unknown", "unproven", "early", "pending", "depending"],
)
LITIGIOUS = word_forms(
    verbs=["adjudicate", "allege", "appeal", "arbitrate", "attest", "depose", "enjoin", "indict", "infringe", "litigate", "mediate", "petition", "plead", "prosecute", "settle", "testify"],
    adjectives=["contractual", "judicial", "juridical", "lawful", "legal", "statutory", "unlawful"],
    nouns=["affidavit", "attorney", "claim", "claimant", "court", "defendant", "deposition", "indictment", "injunction", "judge", "jury", "law", "lawsuit", "lawyer", "plaintiff", "statute", "subpoena", "testimony", "tort", "tribunal", "verdict"],
    others=["herein", "hereby", "hereto", "thereof", "whereas"],
)
CONSTRAINING = word_forms(
    verbs=["bind", "bound", "compel", "confine", "constrain", "dictate", "encumber", "entail", "impose", "inhibit", "limit", "mandate", "obligate", "oblige", "preclude", "prevent", "prohibit", "require", "restrain", "restrict"],
    adjectives=["compulsory", "mandatory", "restrictive", "strict"],
    nouns=["commitment", "constraint", "covenant", "impairment", "limitation", "obligation", "pledge", "prohibition", "requirement", "restriction"],
)
LEXICONS = {"positive": POSITIVE, "negative": NEGATIVE, "uncertain": UNCERTAIN, "litigious": LITIGIOUS, "constraining": CONSTRAINING}


def lexicon_table(spark: SparkSession, lists: dict[str, list[str]] = LEXICONS) -> DataFrame:
    """``(lexicon, term)`` of the given lists."""
    return spark.createDataFrame([(k, t) for k, ts in lists.items() for t in ts], "lexicon string, term string")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(lexicon, term)`` from a JSON file of ``{"name": ["term", ...]}``, terms in lower case, each once a list."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return lists.select(F.explode("m").alias("lexicon", "terms")).select("lexicon", F.explode("terms").alias("term")).select("lexicon", F.lower(F.trim("term")).alias("term")).distinct()


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Risk categories and phrases from such a file, for ``risk.detect``: a taxonomy is configuration and goes to the driver."""
    rows = read_lexicon(spark, path).groupBy("lexicon").agg(F.array_sort(F.collect_list("term")).alias("terms")).collect()
    return {r["lexicon"]: r["terms"] for r in sorted(rows, key=lambda r: r["lexicon"])}
