"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from eventrail.llm import chat, decontaminate, lines, projections, ranked, secrets
from eventrail.llm.bpe import op8_bpe
from eventrail.llm.chat import op1_chat
from eventrail.llm.decontaminate import op5_decontaminate
from eventrail.llm.interleave import op2_interleave
from eventrail.llm.lines import op13_lines
from eventrail.llm.neighbours import op9_neighbours
from eventrail.llm.projections import op10_projections
from eventrail.llm.ranked import op12_ranked
from eventrail.llm.repair import op4_repair
from eventrail.llm.secrets import op3_secrets
from eventrail.llm.simhash import op7_simhash
from eventrail.llm.suffixes import op6_suffixes
from eventrail.llm.whitening import op11_whitening

QUERIES = {
    "op1_chat": op1_chat,
    "op2_interleave": op2_interleave,
    "op3_secrets": op3_secrets,
    "op4_repair": op4_repair,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffixes": op6_suffixes,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_neighbours": op9_neighbours,
    "op10_projections": op10_projections,
    "op11_whitening": op11_whitening,
    "op12_ranked": op12_ranked,
    "op13_lines": op13_lines,
}

ORACLE_SQL = {
    "op1_chat": chat.ORACLE_SQL,
    "op3_secrets": secrets.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op10_projections": projections.ORACLE_SQL,
    "op12_ranked": ranked.ORACLE_SQL,
    "op13_lines": lines.ORACLE_SQL,
}
