"""momentlake.sources"""
