"""The minimum slice: encode, score, pick the best and confirm it independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators.encoders import encode_max_cut
from bitloom.operators.energy import best_sample, cut_energy, energy
from bitloom.schemas import KEY
from catalog.base import Views, query


@query("flagship", """
WITH e AS (
  SELECT e.batch, e.instance_id, s.sample_id,
         sum(CASE WHEN s.x <> t.x THEN e.w ELSE 0 END) AS cut
  FROM {edges} e
  JOIN {samples} s ON s.instance_id = e.instance_id AND s.i = e.u
  JOIN {samples} t ON t.instance_id = e.instance_id AND t.i = e.v AND t.sample_id = s.sample_id
  GROUP BY ALL)
SELECT batch, instance_id, arg_min(sample_id, (-cut, sample_id)) AS sample_id,
       -max(cut) AS energy, max(cut) AS cut_weight
FROM e GROUP BY batch, instance_id""")
def flagship(v: Views):
    v.keep("edges", "samples")
    best = best_sample(energy(encode_max_cut(v.edges, v.sizes), v.samples))
    cuts = cut_energy(v.edges, v.samples).select(
        *KEY, "sample_id", (-F.col("energy")).alias("cut_weight"))
    return best.join(cuts, [*KEY, "sample_id"]).select(
        *KEY, "sample_id", "energy", "cut_weight")
