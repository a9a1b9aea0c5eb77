"""Built-in knowledge: physical laws and programming concepts as seed nodes with their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperspark.operators import topk

#: Name, formula, area, unit.
LAWS = (
    ("Newton's Second Law", "F = m × a", "mechanics", "N = kg⋅m/s²"), ("Newton's Law of Gravity", "F = G × m₁ × m₂ / r²", "mechanics", "N"), ("Conservation of Energy", "E_total = KE + PE = constant", "mechanics", "J"),
    ("Conservation of Momentum", "p = m × v = constant", "mechanics", "kg⋅m/s"), ("Hooke's Law", "F = -k × x", "mechanics", "N/m"), ("Kepler's Third Law", "T² ∝ a³", "mechanics", "s²/m³"), ("Centripetal Force", "F = m × v² / r", "mechanics", "N"),
    ("First Law of Thermodynamics", "ΔU = Q - W", "thermodynamics", "J"), ("Second Law of Thermodynamics", "ΔS ≥ 0", "thermodynamics", "J/K"), ("Ideal Gas Law", "PV = nRT", "thermodynamics", "Pa⋅m³"), ("Stefan-Boltzmann Law", "P = σ × A × T⁴", "thermodynamics", "W"),
    ("Carnot Efficiency", "η = 1 - T_cold/T_hot", "thermodynamics", "dimensionless"), ("Coulomb's Law", "F = k × q₁ × q₂ / r²", "electromagnetism", "N"), ("Ohm's Law", "V = I × R", "electromagnetism", "V = A⋅Ω"), ("Faraday's Law", "EMF = -dΦ/dt", "electromagnetism", "V"),
    ("Maxwell's Equations", "∇⋅E=ρ/ε₀; ∇⋅B=0; ∇×E=-∂B/∂t; ∇×B=μ₀J+μ₀ε₀∂E/∂t", "electromagnetism", "various"), ("Ampere's Law", "∮B⋅dl = μ₀I", "electromagnetism", "T⋅m"), ("Schrödinger Equation", "iℏ ∂ψ/∂t = Ĥψ", "quantum", "J"), ("Heisenberg Uncertainty", "Δx⋅Δp ≥ ℏ/2", "quantum", "kg⋅m²/s"),
    ("Photoelectric Effect", "E = hf - φ", "quantum", "J"), ("de Broglie Wavelength", "λ = h / p", "quantum", "m"), ("Mass-Energy Equivalence", "E = mc²", "relativity", "J"), ("Time Dilation", "t' = t / √(1-v²/c²)", "relativity", "s"), ("Length Contraction", "L' = L × √(1-v²/c²)", "relativity", "m"),
    ("Lorentz Factor", "γ = 1 / √(1-v²/c²)", "relativity", "dimensionless"), ("Wave Equation", "v = f × λ", "waves", "m/s"), ("Snell's Law", "n₁ sin θ₁ = n₂ sin θ₂", "optics", "dimensionless"), ("Doppler Effect", "f' = f × (v+vo)/(v-vs)", "waves", "Hz"),
)


#: Importance of each law, in the same order.
IMPORTANCE = (1.0, 1.0, 1.0, 0.95, 0.85, 0.8, 0.85, 1.0, 1.0, 0.95, 0.85, 0.85, 1.0, 1.0, 0.95, 1.0, 0.9, 1.0, 1.0, 0.9, 0.85, 1.0, 0.95, 0.9, 0.9, 0.95, 0.9, 0.85)
#: What each law says, in the same order.
MEANING = (
    "a force changes the motion of a mass", "masses attract each other", "a closed system keeps its energy", "a closed system keeps its momentum", "a spring pulls back as far as it is stretched",
    "wider orbits take longer", "motion on a circle needs a pull to its centre", "heat and work change the inner energy", "disorder never falls by itself", "pressure, volume and temperature of a gas go together",
    "hot bodies shine with the fourth power", "no engine turns all heat into work", "charges attract or repel each other", "voltage drives current through a resistance", "a changing flux makes a voltage", "fields of charges and currents",
    "currents are ringed by a magnetic field", "a wave function changes with its energy", "place and momentum are never both sharp", "light frees electrons above a threshold", "matter moves as a wave", "mass is energy at rest", "moving clocks run slow", "moving rods are short",
    "how strongly moving frames differ", "speed is frequency times length", "light bends between media", "motion shifts a pitch",
)
#: Programming concepts; the first twenty are code, the others plain concepts.
CODE = (
    "Python programming language", "Python function definition def", "Python class definition OOP", "Python list data structure", "Python dictionary key value", "Python import module package", "Python async await coroutine", "Python exception handling try except",
    "C programming language", "C function void return type", "C struct data type aggregate", "C malloc free memory allocation", "C pointer arithmetic dereference",
    "JavaScript programming language", "JavaScript function arrow callback", "JavaScript async await Promise", "JavaScript class prototype inheritance",
    "Rust programming language memory safety", "Rust borrow checker ownership lifetime", "Rust enum Result Option error handling",
    "function subroutine reusable code", "object oriented programming class inheritance", "loop iteration for while control flow", "recursion recursive base case", "asynchronous concurrent parallel programming", "memory management allocation deallocation", "type system static dynamic typing",
)
#: Links between them by place, with weights.
CODE_LINKS = (
    (0, 1, 0.9), (0, 2, 0.9), (0, 3, 0.8), (0, 4, 0.8), (0, 5, 0.85), (0, 6, 0.75), (0, 7, 0.8), (8, 9, 0.9), (8, 10, 0.9), (8, 11, 0.85), (8, 12, 0.85), (13, 14, 0.9), (13, 15, 0.85), (13, 16, 0.8), (17, 18, 0.95), (17, 19, 0.85),
    (1, 20, 0.9), (9, 20, 0.9), (14, 20, 0.9), (2, 21, 0.9), (16, 21, 0.9), (0, 22, 0.75), (8, 22, 0.75), (6, 24, 0.9), (15, 24, 0.9), (11, 25, 0.9), (18, 25, 0.9),
)
LINK_ABOVE, LINK_FACTOR, LINK_NEAREST = 0.35, 0.8, 8
CODE_NODES = 20


def physics_nodes(spark: SparkSession, start: int = 0) -> DataFrame:
    """``(id, label, type, lang, formula, units, area, importance)``: a node for each law, labelled ``name: meaning``."""
    rows = [(start + i, f"{name}: {MEANING[i]}", "PHYSICS", "LANG_ENGLISH", formula, unit, area, IMPORTANCE[i]) for i, (name, formula, area, unit) in enumerate(LAWS)]
    return spark.createDataFrame(rows, "id long, label string, type string, lang string, formula string, units string, area string, importance double")


def physics_links(nodes: DataFrame) -> DataFrame:
    """``(a, b, weight)``: each law and those of its eight nearest nodes above .35, by .8 of their product. ``nodes (id, v)`` are laws only."""
    near = topk.topk_join(nodes, nodes, LINK_NEAREST, LINK_ABOVE).where(F.col("sim") > LINK_ABOVE)
    return near.select(F.col("q").alias("a"), F.col("id").alias("b"), (LINK_FACTOR * F.col("sim")).alias("weight"))


def code_nodes(spark: SparkSession, start: int = 0) -> DataFrame:
    """``(id, label, type, lang)`` of the programming concepts."""
    rows = [(start + i, label, "CODE" if i < CODE_NODES else "CONCEPT", "LANG_CODE" if i < CODE_NODES else "LANG_ENGLISH") for i, label in enumerate(CODE)]
    return spark.createDataFrame(rows, "id long, label string, type string, lang string")


def code_links(spark: SparkSession, start: int = 0) -> DataFrame:
    """``(a, b, weight, type)`` of their fixed links."""
    return spark.createDataFrame([(start + a, start + b, w, "CODE") for a, b, w in CODE_LINKS], "a long, b long, weight double, type string")
