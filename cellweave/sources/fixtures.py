"""Small published models, as texts."""

from __future__ import annotations

from .text import read_anx

# The models' automata, moves and rates are given data.
TEXTS = {
    "p53-mdm2": """model "p53-mdm2"
automaton DNAdam [0, 1]
automaton Mdm2 [0, 1]
automaton p53 [0, 1]
DNAdam: 0 -> 1 when DNAdam=1 @ 1.0
DNAdam: 1 -> 0 when DNAdam=0 @ 1.0
p53: 0 -> 1 when DNAdam=1 and Mdm2=0 @ 1.0
p53: 1 -> 0 when DNAdam=0 @ 0.5
p53: 1 -> 0 when Mdm2=1 @ 0.5
Mdm2: 0 -> 1 when p53=1 @ 0.8
Mdm2: 1 -> 0 when p53=0 @ 1.0
init DNAdam=1, Mdm2=0, p53=0
""",
    "multivalued-demo": """model "multivalued-demo"
automaton g [0, 1, 2]
automaton r [0, 1]
g: 0 -> 1 when r=1 @ 2.0
g: 1 -> 2 when r=1 @ 1.0
g: 1 -> 0 when r=0 @ 1.0
g: 2 -> 1 when r=0 @ 1.0
r: 0 -> 1 @ 1.0
r: 1 -> 0 @ 0.5
init g=0, r=0
""",
    "phasetype-demo": """model "phasetype-demo"
automaton g [0, 1, 2]
g: 0 -> 1 @ erlang(2, 4.0)
g: 0 -> 2 @ 2.0
init g=0
""",
    "cellfate": """model "cellfate"
automaton Apoptosis [0, 1]
automaton Caspase3 [0, 1]
automaton Caspase8 [0, 1]
automaton FADD [0, 1]
automaton MPT [0, 1]
automaton NFkB [0, 1]
automaton Necrosis [0, 1]
automaton RIP1 [0, 1]
automaton ROS [0, 1]
automaton Survival [0, 1]
automaton TNF [0, 1]
Apoptosis: 0 -> 1 when Caspase3=1 @ 1.0
Apoptosis: 1 -> 0 when Caspase3=0 @ 1.0
Caspase3: 0 -> 1 when Caspase8=1 and NFkB=0 @ 1.0
Caspase3: 1 -> 0 when Caspase8=0 @ 1.0
Caspase3: 1 -> 0 when NFkB=1 @ 1.0
Caspase8: 0 -> 1 when FADD=1 and NFkB=0 @ 1.0
Caspase8: 1 -> 0 when FADD=0 @ 1.0
Caspase8: 1 -> 0 when NFkB=1 @ 1.0
FADD: 0 -> 1 when TNF=1 @ 1.0
FADD: 1 -> 0 when TNF=0 @ 1.0
MPT: 0 -> 1 when ROS=1 @ 1.0
MPT: 1 -> 0 when ROS=0 @ 1.0
NFkB: 0 -> 1 when Caspase8=0 and RIP1=1 @ 1.0
NFkB: 1 -> 0 when RIP1=0 @ 1.0
NFkB: 1 -> 0 when Caspase8=1 @ 1.0
Necrosis: 0 -> 1 when MPT=1 @ 1.0
Necrosis: 1 -> 0 when MPT=0 @ 1.0
RIP1: 0 -> 1 when Caspase8=0 and TNF=1 @ 1.0
RIP1: 1 -> 0 when TNF=0 @ 1.0
RIP1: 1 -> 0 when Caspase8=1 @ 1.0
ROS: 0 -> 1 when NFkB=0 and RIP1=1 @ 1.0
ROS: 1 -> 0 when RIP1=0 @ 1.0
ROS: 1 -> 0 when NFkB=1 @ 1.0
Survival: 0 -> 1 when NFkB=1 @ 1.0
Survival: 1 -> 0 when NFkB=0 @ 1.0
TNF: 0 -> 1 when TNF=1 @ 1.0
TNF: 1 -> 0 when TNF=0 @ 1.0
init Apoptosis=0, Caspase3=0, Caspase8=0, FADD=0, MPT=0, NFkB=0, Necrosis=0, RIP1=0, ROS=0, Survival=0, TNF=1
""",
    "oscillator": """model "oscillator"
automaton a [0, 1]
automaton b [0, 1]
a: 0 -> 1 when b=0
a: 1 -> 0 when b=1
b: 0 -> 1 when a=1
b: 1 -> 0 when a=0
init a=0, b=0
""",
    "delay-chain": """model "delay-chain"
automaton a [0, 1]
automaton b [0, 1]
automaton c [0, 1]
a: 0 -> 1
b: 0 -> 1 when a=1
c: 0 -> 1 when b=1
init a=0, b=0, c=0
""",
}

NETWORKS = {name: read_anx(text) for name, text in TEXTS.items()}
GOALS = (
    ("q01", "p53-mdm2", "p53", 1), ("q02", "p53-mdm2", "Mdm2", 1), ("q03", "multivalued-demo", "g", 2),
    ("q04", "phasetype-demo", "g", 1), ("q05", "cellfate", "Apoptosis", 1), ("q06", "cellfate", "Necrosis", 1),
    ("q07", "cellfate", "Survival", 1), ("q08", "cellfate", "MPT", 1), ("q09", "oscillator", "b", 1), ("q10", "delay-chain", "c", 1),
)
