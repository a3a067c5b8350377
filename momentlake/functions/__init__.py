"""momentlake.functions"""
