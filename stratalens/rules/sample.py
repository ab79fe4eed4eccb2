"""A small pack whose keywords occur in the synthetic tables, for tests against SQL."""

from .pack import Blueprint, Pack, Rule, SignalRule, Unit

SIGNALS = (
    SignalRule("opportunity", "Licensing interest", ("Licensing",), ("license", "token"), "0.86"),
    SignalRule("opportunity", "English reach", ("English",), ("tion", "able"), "0.78"),
    SignalRule("risk", "Contact exposure", ("Contact",), ("@", "secret"), "0.88"),
    SignalRule("risk", "German dependence", ("German",), ("ung", "keit"), "0.72"),
    SignalRule("trend", "Romance growth", ("Romance",), ("que ", "ment"), "0.82"),
)

SAMPLE = Pack(
    topics=(
        Rule("Licensing", ("license",)),
        Rule("Contact", ("@", "token")),
        Rule("German", (" und ", " der ")),
        Rule("Romance", (" que ", " les ", " del ")),
        Rule("English", ("the", "tion")),
    ),
    default_topic="General",
    signals=SIGNALS,
    blueprints=(
        Blueprint("Expand licensing", "High", ("Licensing interest", "English reach")),
        Blueprint("Protect contacts", "Medium", ("Contact exposure", "German dependence", "Romance growth")),
        Blueprint("Nothing to build on", "Low", ("No such signal",)),
    ),
    entities=("Thes", "Tion", "Ung", "Que", "License", "NATO"),
    units=(Unit("Licensing", ("Licensing", "Contact"), ("license", "token")), Unit("Continental", ("German", "Romance"), ("ung ", "que "))),
    partners=(("Tionon", "A"), ("Thesh", "B"), ("Ungkeit", "C"), ("Quement", "A"), ("Zzzz", "D")),
    radar=("License", "Token", "Thes", "Keit", "Zzzz"),
    positive=("license", "able", "tion", "que"),
    negative=("token", "ung", "nt ", "@"),
    impact_base={"Licensing": "0.92", "Contact": "0.88", "German": "0.80", "Romance": "0.76"},
    impact_default="0.62",
    impact_terms=("license", "tion", "ung", "que"),
    urgency_terms=("token", "@", "nt "),
    source_bonus={"en": "0.10", "fr": "0.08", "de": "0.03", "es": "-0.05"},
    probes=(("first vector", ("license", "tion")), ("second vector", ("zzzz",)), ("third vector", ("ung", "que", "zzzz"))),
    name_trust=(("src1", "0.90"), ("src7", "0.72"), ("src", "0.70")),
)
