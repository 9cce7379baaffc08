"""Vocabularies that act as schema. Results depend on every entry and, where it says so, on the order."""

NODE_LABELS = ["Asset", "Incident", "Person", "Procedure", "Regulation", "FailureMode", "Equipment", "LessonLearned", "AuditFinding", "WorkOrder", "Document", "Component", "Metric", "Organization", "MissingCategory"]
RELATIONSHIPS = [
    "OCCURRED_ON", "MAINTAINED_BY", "REPORTED_BY", "CAUSED_BY", "PREVENTS", "VIOLATES", "COMPLIES_WITH", "RELATED_TO", "RESULTED_IN", "APPLIES_TO",
    "LEARNED_FROM", "FOLLOWS", "GOVERNED_BY", "AFFECTED_BY", "DOCUMENTED_IN", "AUTHORED_BY", "INSPECTED_BY", "INVOLVED_IN", "HAS_PROCEDURE", "OPERATED_BY",
    "PERFORMED_ON", "RESPONSE_TO", "FEEDS", "SUPPLIES", "BELONGS_TO", "REFERENCES", "KNOWLEDGE_OWNER", "HAS_KNOWLEDGE_GAP", "DOCUMENTED_BY",
]
RELATIONSHIP_REMAP = {
    "AFFECTS": "AFFECTED_BY", "AFFECT": "AFFECTED_BY", "REQUIRES_INPUT_FROM": "RELATED_TO", "ASSOCIATED_WITH": "RELATED_TO", "CONNECTED_TO": "RELATED_TO", "LINKED_TO": "RELATED_TO",
    "PART_OF": "BELONGS_TO", "OWNED_BY": "KNOWLEDGE_OWNER", "DOCUMENTED_BY_PERSON": "AUTHORED_BY", "WRITTEN_BY": "AUTHORED_BY", "DESCRIBES": "DOCUMENTED_IN", "COVERS": "DOCUMENTED_IN",
    "IMPACTS": "AFFECTED_BY", "USES": "FOLLOWS", "APPLIED_TO": "APPLIES_TO", "WORKS_ON": "PERFORMED_ON", "SUBMITTED_BY": "REPORTED_BY",
}
#: Order as in the tags' prefixes of the fixture.
TAG_WORDS = {"C": "Compressor", "P": "Pump", "R": "Reactor", "B": "Boiler", "HX": "Heat Exchanger", "CT": "Cooling Tower", "V": "Vessel"}
CATEGORIES = ["SOP", "Inspection", "Maintenance", "Failure", "Compliance"]
CATEGORY_OF_RELATIONSHIP = {"MAINTAINED_BY": "Maintenance", "INSPECTED_BY": "Inspection", "RESULTED_IN": "Failure", "CAUSED_BY": "Failure", "COMPLIES_WITH": "Compliance", "VIOLATES": "Compliance", "APPLIES_TO": "SOP", "PREVENTS": "SOP"}
CATEGORY_OF_LABEL = {"Procedure": "SOP", "Incident": "Failure", "FailureMode": "Failure", "Regulation": "Compliance", "AuditFinding": "Compliance", "LessonLearned": "SOP"}
RISK_SIGNALS = ["catastrophic", "emergency", "critical failure", "immediate action", "hazardous", "do not operate", "lockout", "loto", "[content missing]", "[tbd]", "pending safety review", "draft document", "awaiting input"]
STOP_WORDS = ["show", "list", "find", "what", "which", "where", "when", "how", "does", "the", "all", "are", "is", "for", "and", "or", "with", "about", "have", "that", "this", "from", "any", "has", "was", "were", "been", "its", "their", "your", "our"]
#: First family that matches wins.
INTENTS = [
    ("asset", ["pump", "reactor", "compressor", "valve", "asset", "equipment"]),
    ("incident", ["failure", "incident", "accident", "fault", "broke", "failed"]),
    ("procedure", ["sop", "procedure", "how to", "steps", "protocol"]),
    ("compliance", ["regulation", "compliance", "iso", "osha", "requirement"]),
    ("engineer", ["engineer", "who knows", "expert", "person", "staff"]),
    ("risk", ["gap", "missing", "risk", "coverage", "unknown"]),
]
METADATA_WORDS = (["uploaded", "document", "file", "registry", "metadata"], ["how many", "list", "what"])
INTENT_SECTIONS = {"incident": ["work_order", "incident_report", "failure_analysis", "rca", "general"], "procedure": ["procedure", "warning"], "compliance": ["compliance"]}
#: (type, subtype, subclass, keyword) in order; the first keyword that a name holds decides.
ONTOLOGY = [
    ("Equipment", "Pump", "CentrifugalPump", ["P-101", "P-102", "P-103", "PUMP", "CENTRIFUGAL"]),
    ("Equipment", "Pump", "PositiveDisplacementPump", ["P-201"]),
    ("Equipment", "Compressor", "RotaryScrew", ["C-17"]),
    ("Equipment", "Compressor", "Reciprocating", ["COMPRESSOR"]),
    ("Equipment", "Vessel", "PressureVessel", ["V-301"]),
    ("Equipment", "Vessel", "StorageTank", ["TANK"]),
    ("Equipment", "HeatExchanger", "ShellAndTube", ["HX-34", "EXCHANGER"]),
    ("Equipment", "Valve", "ControlValve", ["VALVE", "CV"]),
    ("Equipment", "Valve", "ReliefValve", ["RV", "PSV"]),
    ("Incident", "Mechanical", "BearingFailure", ["BEARING", "SEIZE", "VIBRATION"]),
    ("Incident", "Mechanical", "SealLeak", ["LEAK", "SEAL"]),
    ("Incident", "Electrical", "MotorFailure", ["MOTOR", "TRIP", "SHORT"]),
    ("Incident", "Process", "Overpressure", ["OVERPRESSURE", "HIGH PRESSURE"]),
    ("Incident", "Process", "FlowDeviation", ["NO FLOW", "LOW FLOW"]),
    ("Procedure", "Maintenance", "PreventiveMaintenance", ["PM", "PREVENTIVE", "SCHEDULED"]),
    ("Procedure", "Maintenance", "PredictiveMaintenance", ["PREDICTIVE", "VIBRATION ANALYSIS"]),
    ("Procedure", "Inspection", "VisualInspection", ["VISUAL", "WALKDOWN"]),
    ("Procedure", "Inspection", "NDT", ["NON-DESTRUCTIVE", "ULTRASONIC", "RADIOGRAPHY"]),
]
INACTIVE = ["deleted", "deleting", "failed", "failed_delete"]
