"""The aerospace and defence pack."""

from .pack import Blueprint, Pack, Rule, SignalRule, Unit

# Fixed values throughout this file: labels, keywords, weights and thresholds that results depend on.

TOPICS = (
    Rule("FCAS", ("fcas", "future combat air system", "sixth-generation", "sixth generation")),
    Rule("Eurofighter", ("eurofighter", "typhoon")),
    Rule("Uncrewed Combat Aircraft", ("uncrewed", "unmanned", "uas", "uav", "drone", "eurodrone", "sirtap")),
    Rule("Crewed-Uncrewed Teaming", ("crewed-uncrewed", "manned-unmanned", "teaming", "loyal wingman")),
    Rule("Military Transport", ("a400m", "c295", "cn235", "transport aircraft")),
    Rule("Aerial Refuelling", ("a330 mrtt", "mrtt", "tanker", "refuelling", "refueling")),
    Rule("Military Space", ("satellite", "space", "secure communications", "earth observation")),
    Rule("European Defence Autonomy", ("european defence", "strategic autonomy", "defence autonomy")),
    Rule("Competitor Activity", ("dassault", "boeing", "lockheed", "bae systems", "leonardo", "saab")),
    Rule("Supply Chain", ("supply chain", "delivery delay", "production delay", "shortage")),
    Rule("Policy and Procurement", ("nato", "ministry of defence", "procurement", "contract", "order")),
)

SIGNALS = (
    SignalRule("opportunity", "Growing demand for uncrewed aircraft", ("Uncrewed Combat Aircraft",), ("uncrewed", "unmanned", "uav", "uas", "sirtap", "eurodrone", "collaborative combat", "drone"), "0.86"),
    SignalRule("opportunity", "Next-generation fighter programme", ("FCAS",), ("fcas", "future combat air system", "sixth-generation", "combat cloud", "fighter"), "0.84"),
    SignalRule("opportunity", "Fighter modernisation", ("Eurofighter",), ("eurofighter", "typhoon", "modernization", "upgrade", "radar", "combat"), "0.78"),
    SignalRule("opportunity", "Military space services", ("Military Space",), ("satellite", "space", "secure communications", "earth observation", "military satellite"), "0.80"),
    SignalRule("opportunity", "European procurement momentum", ("European Defence Autonomy", "Policy and Procurement"), ("nato", "european defence", "strategic autonomy", "sovereign", "procurement", "defence spending"), "0.82"),
    SignalRule("risk", "Programme governance dispute", ("FCAS",), ("dispute", "delay", "collapse", "tension", "dassault", "workshare", "fragmentation", "uncertainty"), "0.88"),
    SignalRule("risk", "Competitor pressure", ("Eurofighter", "FCAS", "Competitor Activity"), ("lockheed", "boeing", "bae systems", "dassault", "leonardo", "saab", "gcap", "tempest", "f-35"), "0.78"),
    SignalRule("risk", "Delivery and supply strain", ("Supply Chain", "Military Transport", "Aerial Refuelling"), ("supply chain", "delay", "shortage", "production", "delivery", "cost overrun"), "0.76"),
    SignalRule("risk", "Regulation and budget exposure", ("Policy and Procurement", "European Defence Autonomy"), ("export", "regulation", "procurement", "budget", "ministry", "parliament", "approval"), "0.72"),
    SignalRule("trend", "Crewed and uncrewed teaming", ("Uncrewed Combat Aircraft", "Eurofighter", "FCAS"), ("crewed-uncrewed", "manned-unmanned", "teaming", "collaborative combat", "loyal wingman", "uncrewed"), "0.84"),
    SignalRule("trend", "Sovereign European capability", ("European Defence Autonomy", "Policy and Procurement"), ("european defence", "sovereign", "strategic autonomy", "nato", "procurement"), "0.82"),
    SignalRule("trend", "Resilient space systems", ("Military Space",), ("space", "satellite", "secure communications", "resilience", "earth observation"), "0.78"),
)


def _signals(*numbers: int) -> tuple[str, ...]:
    return tuple(SIGNALS[n - 1].title for n in numbers)


DOMAIN = Pack(
    topics=TOPICS,
    default_topic="General Airbus Strategy",
    signals=SIGNALS,
    blueprints=(
        Blueprint("Scale the uncrewed portfolio", "High", _signals(1, 2, 10)),
        Blueprint("Secure the next fighter programme", "High", _signals(2, 6, 10)),
        Blueprint("Modernise the fighter in service", "High", _signals(3, 7, 10)),
        Blueprint("Grow military space", "High", _signals(4, 12, 5)),
        Blueprint("Align with European procurement", "Medium", _signals(5, 11, 9)),
        Blueprint("Protect delivery", "Medium", _signals(8, 9)),
    ),
    entities=(
        "Airbus", "Airbus Defence and Space", "Dassault", "Boeing", "Lockheed Martin", "BAE Systems", "Leonardo", "Saab", "Thales", "Rheinmetall",
        "NATO", "European Union", "European Defence Agency", "German Air Force", "Spanish Ministry of Defence", "French Armed Forces", "Eurofighter",
        "FCAS", "SIRTAP", "Eurodrone", "A400M", "A330 MRTT", "C295",
    ),
    units=(
        Unit("Airbus Defence and Space", ("FCAS", "Eurofighter", "Uncrewed Combat Aircraft", "Military Space", "Military Transport", "Aerial Refuelling", "European Defence Autonomy", "Policy and Procurement", "Supply Chain"), ("defence", "defense", "military", "airbus defence and space", "fighter", "satellite", "secure communications", "nato")),
        Unit("Future Combat / FCAS", ("FCAS", "European Defence Autonomy"), ("fcas", "future combat air system", "sixth-generation", "sixth generation", "future fighter", "combat cloud", "next generation fighter")),
        Unit("Eurofighter", ("Eurofighter",), ("eurofighter", "typhoon", "fighter modernization", "radar upgrade")),
        Unit("Uncrewed Systems", ("Uncrewed Combat Aircraft",), ("uncrewed", "unmanned", "uav", "uas", "drone", "sirtap", "eurodrone", "collaborative combat", "loyal wingman", "crewed-uncrewed", "manned-unmanned")),
        Unit("Military Space", ("Military Space",), ("space", "satellite", "secure communications", "earth observation", "military satellite", "space resilience")),
        Unit("Military Transport", ("Military Transport",), ("a400m", "c295", "cn235", "military transport", "transport aircraft")),
        Unit("Aerial Refuelling", ("Aerial Refuelling",), ("a330 mrtt", "mrtt", "tanker", "refuelling", "refueling")),
        Unit("Supply Chain & Execution", ("Supply Chain", "Military Transport", "Aerial Refuelling"), ("supply chain", "supplier", "delivery", "shortage", "production", "cost overrun", "execution", "manufacturing")),
        Unit("Policy & Procurement", ("Policy and Procurement", "European Defence Autonomy"), ("procurement", "contract", "ministry", "government", "budget", "export", "regulation", "policy", "nato", "sovereign", "strategic autonomy", "european defence")),
        Unit("Competitor Radar", ("Competitor Activity", "FCAS", "Eurofighter"), ("dassault", "boeing", "lockheed", "bae systems", "leonardo", "saab", "thales", "rheinmetall", "f-35", "gcap", "tempest")),
    ),
    partners=(("Indra", "Spain"), ("Dassault", "France"), ("Leonardo", "Italy"), ("BAE Systems", "United Kingdom"), ("Thales", "France"), ("Rheinmetall", "Germany"), ("Saab", "Sweden"), ("OHB", "Germany"), ("GMV", "Spain")),
    radar=("Dassault", "Boeing", "Lockheed", "BAE", "Leonardo", "Saab", "Thales", "Rheinmetall", "NATO", "European Defence"),
    positive=("launch", "contract", "signed", "growth", "opportunity", "investment", "partnership", "modernization", "secure", "success", "expand", "advance", "accelerate", "award", "selected"),
    negative=("risk", "delay", "dispute", "collapse", "uncertainty", "shortage", "tension", "overrun", "cut", "problem", "threat", "concern", "fragmentation"),
    impact_base={
        "FCAS": "0.92", "Uncrewed Combat Aircraft": "0.90", "European Defence Autonomy": "0.88", "Eurofighter": "0.84", "Military Space": "0.82",
        "Competitor Activity": "0.80", "Policy and Procurement": "0.78", "Aerial Refuelling": "0.76", "Supply Chain": "0.74", "Military Transport": "0.72",
    },
    impact_default="0.62",
    impact_terms=("contract", "procurement", "nato", "ministry of defence", "sixth-generation", "future combat", "autonomous", "satellite", "strategic", "sovereign", "combat cloud"),
    urgency_terms=("urgent", "delay", "risk", "dispute", "contract", "announced", "signed", "launches", "procurement", "deadline", "2026", "2027", "2028", "2029"),
    source_bonus={"official": "0.10", "policy": "0.08", "competitor": "0.04", "news": "0.03", "community": "-0.05"},
    name_trust=(
        ("reuters", "0.90"), ("airbus", "0.95"), ("defense news", "0.84"), ("breaking defense", "0.84"), ("aviation week", "0.84"), ("flightglobal", "0.82"),
        ("janes", "0.86"), ("nato", "0.90"), ("defence industry europe", "0.78"), ("army recognition", "0.72"), ("defence blog", "0.70"),
        ("the defense post", "0.72"), ("aerotime", "0.70"),
    ),
    probes=(
        ("FCAS partner risk Dassault future fighter", ("fcas", "dassault", "fighter")),
        ("SIRTAP uncrewed aircraft opportunity Airbus", ("sirtap", "uncrewed", "airbus")),
        ("military space secure communications Airbus", ("space", "satellite", "communications")),
        ("Eurofighter modernization uncrewed teaming", ("eurofighter", "typhoon", "uncrewed")),
        ("A400M C295 MRTT Airbus defence production delivery execution risk", ("a400m", "c295", "mrtt", "delivery", "production", "execution", "risk")),
    ),
)
