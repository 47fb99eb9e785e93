"""Options of an assembly."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """k: odd k-mer length, 19 to 127. cutoff: least multiplicity of an arc. The rest says what is read and written."""

    k: int = 23
    cutoff: int = 5
    input: str = ""
    output: str = ""
    kmer_graph: bool = False
    edge_list: bool = False
    contig_graph: bool = False
    performance: bool = False
    split: bool = False
    resume: str = ""

    def __post_init__(self):
        if self.k % 2 == 0 or not 19 <= self.k <= 127:
            raise ValueError(f"k must be odd and within 19..127, not {self.k}")
        if not self.input and not self.resume and self.output:
            raise ValueError("give reads or a graph to go on from")


def parse(argv: list[str] | None = None) -> Params:
    p = argparse.ArgumentParser(prog="loomgraph", description="De-novo assembly of reads on Spark")
    p.add_argument("-k", type=int, default=23, help="k-mer length, odd, 19 to 127")
    p.add_argument("-c", type=int, default=5, dest="cutoff", help="least multiplicity of an arc")
    p.add_argument("-i", default="", dest="input", help="FASTA file or folder")
    p.add_argument("-o", required=True, dest="output", help="output folder")
    p.add_argument("-s", action="store_true", dest="kmer_graph", help="write the k-mer graph and stop before simplification")
    p.add_argument("-j", action="store_true", dest="edge_list", help="write the edge lists")
    p.add_argument("-d", action="store_true", dest="contig_graph", help="write the contig graph")
    p.add_argument("-p", action="store_true", dest="performance", help="write contigs before error removal and stop")
    p.add_argument("-x", action="store_true", dest="split", help="split nodes that two walks cross, by multiplicity")
    p.add_argument("-r", default="", dest="resume", help="go on from a contig graph written with -d, instead of reads")
    p.add_argument("-v", action="version", version="loomgraph 0.1")
    return Params(**vars(p.parse_args(argv)))
