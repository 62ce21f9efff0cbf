"""The time-stepped plan: emit, gather, solve, push, move, collide, settle, stop. State is tables; each step ends in files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.constants import BOX_EXPANSION, MIN_SPEED, species_table
from ionframe.functions import vectors as V
from ionframe.functions.physics import boris_push, collide, kinetic_energy, moved
from ionframe.operators import fem, gather, spatial
from ionframe.storage import materialise


@dataclass
class Run:
    dt: float
    duration: float
    gas: str
    model: str
    concentration: float
    edge: float
    seed: int = 0
    sputtering: bool = False
    solver: str = "CG"
    solver_settings: dict = field(default_factory=dict)

    def steps(self) -> int:
        """How many steps the accumulated time stays within the duration, ends included."""
        n, t = 0, 0.0
        while t <= self.duration:
            n, t = n + 1, t + self.dt
        return n


@dataclass
class State:
    particles: DataFrame  # id, species, pos, v, energy_j
    settled: DataFrame  # particle_id, tri_id, step
    tracks: DataFrame  # particle_id, seq, x, y, z


def initial(particles: DataFrame) -> State:
    spark = particles.sparkSession
    return State(
        materialise(particles.select("id", "species", "pos", "v", "energy_j"), "particles"),
        spark.createDataFrame([], "particle_id long, tri_id long, step int"),
        spark.createDataFrame([], "particle_id long, seq int, x double, y double, z double"),
    )


def fields(particles: DataFrame, tetras: DataFrame, conditions: DataFrame, matrix: DataFrame, run: Run) -> DataFrame:
    """(id, e): the field at each located particle, from charges gathered to nodes and the solved potential."""
    species = F.broadcast(species_table(particles.sparkSession).select("species", "charge_c"))
    located = materialise(spatial.containing_tetras(particles, tetras, run.edge).join(particles.select("id", "species"), "id").join(species, "species"), "located")
    cells = gather.tetra_charge(located, fem.with_gradients(tetras).select("tetra_id", "volume"))
    density = gather.node_density(cells, fem.tetra_nodes(tetras))
    nodes = fem.tetra_nodes(tetras).select("node_id").distinct()
    rhs = nodes.join(density, "node_id", "left").select((F.col("node_id") - 1).alias("idx"), F.coalesce("value", F.lit(0.0)).alias("value"))
    potential = fem.solve(matrix, rhs, conditions, run.solver, fem.solver_options(run.solver, run.solver_settings)).select((F.col("idx") + 1).alias("node_id"), F.col("value").alias("phi"))
    at = located.groupBy("id").agg(F.min("tetra_id").alias("tetra_id"))
    return at.join(fem.field(tetras, potential), "tetra_id").select("id", V.vec("ex", "ey", "ez").alias("e"))


def step(state: State, number: int, run: Run, triangles: DataFrame, box: dict, electric: DataFrame | None = None) -> State:
    """One step: who still flies, fast enough and inside the box, is pushed, recorded, moved, collides and may settle."""
    spark = state.particles.sparkSession
    species = F.broadcast(species_table(spark).select("species", "mass", "radius", "charge_c"))
    flying = gather.fast(gather.unsettled(state.particles, state.settled), MIN_SPEED)
    for a in "xyz":
        middle, half = (box[f"{a}_min"] + box[f"{a}_max"]) / 2, (box[f"{a}_max"] - box[f"{a}_min"]) / 2 * BOX_EXPANSION
        flying = flying.where(F.col("pos")[a].between(middle - half, middle + half))
    wide = flying.join(species, "species")
    zero = V.vec(0, 0, 0)
    if electric is not None:
        wide = wide.join(electric, "id", "left").withColumn("e", F.coalesce("e", zero)).withColumn("b", zero)
        wide = boris_push(wide, run.dt).drop("e", "b")
    wide = wide.withColumn("p0", F.col("pos")).withColumn("pos", moved(F.col("pos"), F.col("v"), run.dt))
    wide = collide(wide, run.model, run.gas, run.concentration, run.dt, run.seed, number).withColumn("energy_j", kinetic_energy(F.col("mass"), F.col("v")))
    now = materialise(wide.select("id", "species", "p0", "pos", "v", "energy_j"), "moved")
    hits = spatial.first_hits(now.select("id", "p0", F.col("pos").alias("p1")), triangles, run.edge)
    fresh = materialise(hits.select(F.col("id").alias("particle_id"), "tri_id", F.lit(number).alias("step")), "settled")
    seen = now.select(F.col("id").alias("particle_id"), F.lit(number).alias("seq"), "p0.x", "p0.y", "p0.z")
    others = state.particles.join(now.select("id"), "id", "left_anti").join(state.settled.select(F.col("particle_id").alias("id")), "id", "left_anti")
    particles = now.select("id", "species", "pos", "v", "energy_j").unionByName(others)
    return State(materialise(particles, "particles"), materialise(state.settled.unionByName(fresh), "settled"), materialise(state.tracks.unionByName(seen), "tracks"))


def simulate(particles: DataFrame, triangles: DataFrame, box: dict, run: Run, tetras: DataFrame | None = None, conditions: DataFrame | None = None, emit=None) -> State:
    """All steps, until the time is over or every particle has settled. With ``emit`` and sputtering, particles are added in
    every step but the first and the last; without sputtering, and given tetrahedra, the field is solved in each step."""
    state, total = initial(particles), particles.count()
    solve = not run.sputtering and tetras is not None and conditions is not None
    matrix = materialise(fem.stiffness(tetras), "stiffness") if solve else None
    last = run.steps() - 1
    for number in range(last + 1):
        if run.sputtering and emit is not None and 0 < number < last:
            more = materialise(emit(number), "emitted")
            total += more.count()
            state.particles = state.particles.unionByName(more.select(*state.particles.columns))
        electric = fields(gather.unsettled(state.particles, state.settled), tetras, conditions, matrix, run) if solve else None
        state = step(state, number, run, triangles, box, electric)
        if state.settled.count() >= total:
            break
    return state
