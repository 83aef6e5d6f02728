"""Named refusals: raised before any row is read wherever the schema decides them."""


class Refusal(Exception):
    """Base of all refusals."""


def _kind(name: str, doc: str) -> type[Refusal]:
    return type(name, (Refusal,), {"__doc__": doc, "__module__": __name__})


UnknownColumn = _kind("UnknownColumn", "A column the schema does not have.")
TypeMismatch = _kind("TypeMismatch", "Operand types that do not go together.")
AggError = _kind("AggError", "An aggregate over a column of a type it does not take.")
JoinError = _kind("JoinError", "Join keys or set operands that do not fit.")
ArityError = _kind("ArityError", "A wrong number of arguments.")
UnresolvedSource = _kind("UnresolvedSource", "A named source the host does not know.")
OverflowRefused = _kind("OverflowRefused", "A number that does not fit its type.")
UnboundParam = _kind("UnboundParam", "A parameter without a value.")
UnpinnedClock = _kind("UnpinnedClock", "The clock is read but was not given.")
UnitMismatch = _kind("UnitMismatch", "Units that do not agree.")
FunctionError = _kind("FunctionError", "An unknown or ill-called function.")
RecursiveFunction = _kind("RecursiveFunction", "A function that reaches itself.")
ExpansionTooLarge = _kind("ExpansionTooLarge", "Inlined functions exceed the node limit.")
InvalidKnots = _kind("InvalidKnots", "Curve knots that are too few, unordered or not finite.")
UnsupportedFit = _kind("UnsupportedFit", "A family, link or output that is not offered.")
FitError = _kind("FitError", "A fit that the data do not allow.")
KMeansError = _kind("KMeansError", "A clustering step that cannot run.")
BootstrapError = _kind("BootstrapError", "A resampling step that cannot run.")
CodecError = _kind("CodecError", "A document that does not decode.")
DeltaError = _kind("DeltaError", "A change set that does not fit its tables.")
EditRejected = _kind("EditRejected", "A column edit that cannot be applied or undone.")
RegistryError = _kind("RegistryError", "A query that is not registered or does not match its declaration.")
TreeError = _kind("TreeError", "A pipeline tree edit that does not apply.")
LinAlgRefused = _kind("LinAlgRefused", "Shapes that do not fit, or a triangle that cannot be solved.")
