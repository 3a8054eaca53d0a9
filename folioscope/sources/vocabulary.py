"""Domain vocabularies: data that the extractors are given, in order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical names and their aliases, in the order that decides which alias wins.
ELEMENTS = {
    "Si": "Silicon", "Cr": "Chromium", "Mn": "Manganese", "Al": "Aluminum", "Cu": "Copper", "Ni": "Nickel", "Ti": "Titanium", "Nb": "Niobium", "V": "Vanadium",
    "Zr": "Zirconium", "C": "Carbon", "N": "Nitrogen", "S": "Sulfur", "P": "Phosphorus", "Mo": "Molybdenum", "B": "Boron", "Fe": "Iron", "Co": "Cobalt",
    "La": "Lanthanum", "Ce": "Cerium", "Nd": "Neodymium", "Y": "Yttrium", "Ca": "Calcium", "Bi": "Bismuth", "Sn": "Tin", "Sb": "Antimony", "Mg": "Magnesium",
}
PROPERTIES = {
    "yield_stress": ["yield stress", "yield strength", "σy"],
    "tensile_strength": ["tensile strength", "UTS"],
    "elongation": ["elongation", "fracture elongation"],
    "core_loss": ["core loss", "iron loss", "W/kg"],
    "magnetic_flux": ["magnetic flux density", "B50", "B8"],
    "resistivity": ["resistivity", "electrical resistivity"],
    "hardness": ["hardness", "Vickers hardness", "HV"],
}
PROCESSES = {
    "hot_rolling": ["hot rolling", "hot rolled", "hot-rolling"],
    "cold_rolling": ["cold rolling", "cold rolled", "cold-rolling"],
    "annealing": ["annealing", "annealed", "finish annealing"],
    "pickling": ["pickling", "pickled", "acid pickling"],
    "coating": ["coating", "coated", "insulation coating"],
    "heat_treatment": ["heat treatment", "heat treated"],
}
APPLICATIONS = {
    "electric_vehicle": ["electric vehicle", "EV", "electric car", "electric motor vehicle"],
    "transformer": ["transformer", "power transformer", "distribution transformer"],
    "electric_motor": ["electric motor", "motor core", "rotating machine"],
    "generator": ["generator", "power generator", "wind turbine generator"],
    "inductor": ["inductor", "reactor", "choke coil"],
    "sensor": ["sensor", "magnetic sensor"],
    "energy_storage": ["energy storage", "battery", "fuel cell"],
    "power_electronics": ["power electronics", "inverter", "converter"],
}
MATERIALS = {
    "grain_oriented_electrical_steel": ["grain-oriented electrical steel", "grain oriented electrical steel", "GO steel", "GO electrical steel"],
    "non_oriented_electrical_steel": ["non-oriented electrical steel", "non oriented electrical steel", "NO steel", "NO electrical steel"],
    "electrical_steel_sheet": ["electrical steel sheet", "magnetic steel sheet"],
    "silicon_steel": ["silicon steel", "Si steel", "Fe-Si"],
    "high_strength_steel": ["high strength steel", "high-strength steel", "HSLA steel"],
    "stainless_steel": ["stainless steel", "austenitic stainless", "ferritic stainless"],
    "carbon_steel": ["carbon steel", "low carbon steel", "ultra-low carbon steel"],
    "rare_earth_metal": ["rare earth metal", "rare earth metals", "REM", "REMs", "rare earth element", "rare earth elements", "REE", "REM oxysulfide", "REM oxysulfides"],
}
# Phrases that mark a problem or a solution, the first found wins.
PROBLEMS = ["problem", "drawback", "disadvantage", "limitation", "difficulty", "deficiency", "shortcoming", "insufficient"]
SOLUTIONS = [
    "the present invention provides", "advantage of the invention", "object of the invention", "the invention overcomes", "the invention solves",
    "according to the present invention", "an object of the present invention",
]

DEFAULT = {"elements": ELEMENTS, "properties": PROPERTIES, "processes": PROCESSES, "applications": APPLICATIONS, "materials": MATERIALS, "problems": PROBLEMS, "solutions": SOLUTIONS}


def as_table(spark: SparkSession, vocabulary: dict = DEFAULT) -> DataFrame:
    """``kind, canon_ord, canon_id, alias_ord, alias``"""
    rows = []
    for kind in ("properties", "processes", "applications", "materials"):
        for i, (canon, aliases) in enumerate(vocabulary[kind].items()):
            rows += [(kind, i, canon, j, alias) for j, alias in enumerate(aliases)]
    return spark.createDataFrame(rows, "kind string, canon_ord int, canon_id string, alias_ord int, alias string")
