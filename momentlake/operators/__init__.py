"""momentlake.operators"""
