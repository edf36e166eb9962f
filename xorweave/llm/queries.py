"""The queries of this folder, and the SQL of those that SQL can express."""

from . import ann, bpe, chat, dedup, lm, media, mixing, negatives, pages, quality, repair, shards, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_near_dedup": dedup.op3_near_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_media": media.op6_media,
    "op7_lm_score": lm.op7_lm_score,
    "op8_html": pages.op8_html,
    "op9_ann": ann.op9_ann,
    "op10_chat": chat.op10_chat,
    "op11_repair": repair.op11_repair,
    "op12_sharding": shards.op12_sharding,
    "op13_negatives": negatives.op13_negatives,
}
SQL = {"op1_mixing": mixing.OP1_SQL, "op3_near_dedup": dedup.OP3_SQL, "op9_ann": ann.OP9_SQL, "op13_negatives": negatives.OP13_SQL}
